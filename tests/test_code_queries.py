"""Queries over generated source files, held against their SQL forms."""

import ast
import glob
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corvina.operators import graph, memory, state
from corvina.functions import models, parsing
from corvina.plans import catalog, code_queries, projections

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [*code_queries.QUERIES, "J10_untracked_paths", "M10_L8_memory_refs"])
def test_query_equals_sql(spark, sql, name):
    got = catalog.queries()[name](spark, SF)
    want = sql.execute(catalog.oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_reindexed_drops_old_windows(spark):
    vectors = spark.createDataFrame([("mem_a", [1.0]), ("mem_a_c9", [1.0]), ("mem_b_c1", [1.0])], "id string, vector array<float>")
    notes = spark.createDataFrame([("mem_a", "t", "one two")], "id string, topic string, content string")
    after = memory.reindexed(vectors, notes, lambda t: models.hash_embedding(t, 8))
    assert {(r["id"], len(r["vector"])) for r in after.collect()} == {("mem_a", 8), ("mem_b_c1", 1)}


def test_hash_embedding_has_unit_norm(spark):
    rows = spark.createDataFrame([("a b b",), ("",), (None,)], "t string").select(models.hash_embedding("t", 8).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-6
    assert rows[1]["v"] == [0.0] * 8


def test_renamed_files_leaves_other_branches(spark):
    rows = spark.createDataFrame([("r", "main", "a", 1), ("r", "dev", "a", 2)], "repo string, branch string, file string, n int")
    moves = spark.createDataFrame([("r", "main", "a", "b")], "repo string, branch string, file string, new_file string")
    assert {(r["branch"], r["file"]) for r in state.renamed_files(rows, moves).collect()} == {("main", "b"), ("dev", "a")}


def test_files_are_dealt_to_tasks_by_rows(spark, tmp_path):
    keys = spark.range(50_000).select(F.col("id").alias("p_partkey"), F.col("id").alias("page_id")).coalesce(1)
    for name in ("part", "pages"):
        keys.write.parquet(f"{tmp_path}/{name}.parquet")
    for made in (code_queries.python_files, code_queries.code_files, code_queries.web_files):
        sizes = [r["n"] for r in made(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 50_000 and len(sizes) == 3 and max(sizes) < 20_000


def test_segments_are_those_of_the_standard_library():
    text = "import ä, b; x = 'é'\r\nclass Ü:\n    def é(self): return self.a.b(1), (2).c(), d[0].e(), f().g.h()\r    def m(self):\n        '''a\x0cb\r\n'''\n        import q\n\n    y = 1\n"
    got = parsing.parse(text, "python")
    tree = ast.parse(text)
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, ast.FunctionDef))]
    assert sorted(s.body for s in got.symbols) == sorted(ast.get_source_segment(text, n) for n in nodes)
    assert sorted(got.imports) == sorted(ast.get_source_segment(text, n) for n in ast.walk(tree) if isinstance(n, ast.Import))
    assert parsing._dotted(ast.parse("a.b(c).d.e", mode="eval").body) == "a.b(c).d.e" and parsing._dotted(ast.parse("a.b.c", mode="eval").body) == "a.b.c"
    # Work follows the length of a file.
    long = "".join(f"def f{k}():\n    pass\n" for k in range(20_000))
    began = time.perf_counter()
    assert len(parsing.parse(long, "python").symbols) == 20_000 and time.perf_counter() - began < 20


def test_edges_are_parted_by_rows(spark, monkeypatch):
    whole = sorted(map(tuple, projections.frame(spark, SF, "edges").collect()))
    monkeypatch.setattr(projections, "TASK_ROWS", 500)
    edges = projections.frame(spark, SF, "edges")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count(", 12)") == 2
    assert edges.rdd.getNumPartitions() == 12 and sorted(map(tuple, edges.collect())) == whole and len(whole) == len(set(whole))
    # Levels of few and of many symbols come to the same.
    few = sorted(map(tuple, graph.impact(edges, "p5", 3).collect()))
    monkeypatch.setattr(graph, "SMALL_LEVEL", 0)
    monkeypatch.setattr(graph, "TASK_STEPS", 700)
    assert sorted(map(tuple, graph.impact(edges, "p5", 3).collect())) == few and len(few) > 100
