"""Compositions, sources, indexes, registry and streams of the engine."""

import os
import subprocess

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.functions import chunking, columns as C, models, parsing
from corvina.functions.stemming import Analysis, stemmed
from corvina.operators import budget, compose, memory, retrieval, state
from corvina.plans import session
from corvina.sources import files, legacy, tables
from corvina.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, text, made", [
    ("a/node_modules/x.js", "", True), ("build/x.java", "", False), ("target/x.rs", "", False), ("bower_components/x", "", True), ("a/dist", "", True), ("a.min.js", "", True), ("x-lock.json", "", True), ("x-lock.json.txt", "", False),
    ("x", "é" * 500, False), ("x", "é" * 501, True), ("x", "a" * 1000 + "\r\nb", False), ("x", "a\n" + "b" * 1001, True),
])
def test_generated(spark, path, text, made):
    assert one(spark, C.generated(F.lit(path), F.lit(text))) is made


def test_prose_paths(spark):
    text = "See `src/a.scss`, «b.xml» (c.kt); a.md x.json .ts src/.ts d.JAVA e.properties... *f.py* a:b.go src/a.scss"
    assert one(spark, C.prose_paths(F.lit(text))) == ["src/a.scss", "c.kt", "e.properties", "f.py", "b.go"]


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "dir é").mkdir()
    (tmp_path / "dir é" / "b b.py").write_text("é\n\n")
    (tmp_path / "bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "empty").write_text("")
    run("add", ".")
    run("commit", "-qm", "1")
    run("checkout", "-qb", "feature")
    (tmp_path / "a.py").write_text("x = 2\n")
    run("mv", "empty", "moved")
    run("commit", "-qam", "2")
    got = {r["path"]: r["text"] for r in files.branch_files(spark, str(tmp_path), "main").collect()}
    assert got == {"a.py": "x = 1\n", "dir é/b b.py": "é\n\n", "empty": ""}
    assert {r["file"]: r["text"] for r in files.work_tree(spark, str(tmp_path)).where("file NOT LIKE '.git/%'").collect()}["a.py"] == "x = 2\n"
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "x.log").write_text("")
    assert {r["path"] for r in files.listing(spark, str(tmp_path)).collect()} == {"a.py", "dir é/b b.py", "bin", "moved", ".gitignore"}
    changed = {(r["status"], r["path"], r["from_path"]) for r in state.name_status(files.diff_lines(spark, str(tmp_path), "main")).collect()}
    assert ("modified", "a.py", None) in changed and any(p in ("moved", "empty") for _, p, _ in changed)


def test_index_finds_nine_tenths(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 24))
    x = (centres[r.integers(0, 40, 4000)] + 0.6 * r.standard_normal((4000, 24))).astype(np.float32)
    v = spark.createDataFrame([(k, x[k].tolist()) for k in range(4000)] + [(9000, None)], "id long, vector array<float>")
    q = v.where("id % 20 = 0 AND id < 9000").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exact = retrieval.knn_join(v, q, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::20].astype(np.float64) @ unit.astype(np.float64).T
    assert {(r["query_id"], r["id"]) for r in exact.collect()} == {(20 * k, int(j)) for k in range(200) for j in np.argsort(-s[k], kind="stable")[:5]}
    index = retrieval.build_index(v)
    told = retrieval.recall_of(retrieval.search_index(index, q, 5, 8), exact).agg(F.sum("hits").alias("h"), F.sum("wanted").alias("w")).first()
    assert told["w"] == 1000 and told["h"] >= 900
    assert index.cells.count() == 4000
    with pytest.raises(ValueError):
        retrieval.search_index(index, q, 5, 8, metric="ip")


def test_knn_join_takes_queries_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "id long, vector array<float>")
    q = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, retrieval.knn_join(v, q, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    assert sorted(map(tuple, retrieval.knn_join(v, q, 3).select("query_id", "id", "rank").collect())) == whole and len(whole) == 90
    assert retrieval.knn_join(v, q.limit(0), 3).count() == 0


def test_keyword_index_equals_scan(spark):
    d = spark.createDataFrame([(1, "The cat. the CAT sat"), (2, "dog the"), (3, ""), (4, None), (5, "cats cat-dog")], "id long, text string")
    index = retrieval.build_keyword_index(d)
    for query in ("the cat", "dog", "nothing here", "", "x1"):
        scan = {r["id"]: round(r["score"], 9) for r in retrieval.bm25(d.fillna("", "text"), query).collect()}
        assert {r["id"]: round(r["score"], 9) for r in retrieval.bm25_indexed(index, query).collect()} == scan


def points(spark):
    return spark.createDataFrame([(1, "auth database", "rust", [1.0, 0.0], False), (2, "the database connection pool", "python", [0.0, 1.0], False), (3, "cache", "python", [0.7, 0.7], False), (4, "database", "rust", [1.0, 0.1], True)], "id long, text string, language string, vector array<float>, is_deletion boolean")


def test_tool_search(spark):
    def none():
        raise compose.NoKeywordIndex

    p = points(spark)
    with pytest.raises(compose.NoKeywordIndex):
        compose.tool_search(p, "database", None, "keyword", keyword_index=none)
    alone = compose.tool_search(p, "database", [1.0, 0.0], "hybrid", 2, keyword_index=none).collect()
    assert [(r["id"], r["score_kind"]) for r in alone] == [(1, "cosine"), (3, "cosine")]
    both = compose.tool_search(p, "database connection", [1.0, 0.0], "hybrid", 5).collect()
    assert {r["id"] for r in both} == {1, 2, 3} and {r["score_kind"] for r in both} == {"rrf"}
    assert [r["id"] for r in compose.tool_search(p, "database connection", None, "keyword", 5, "python", rerank="noop").collect()] == [2]
    assert compose.tool_search(p, "cache", [1.0, 0.0], "vector", 1, rerank="lexical").first()["id"] == 3
    with pytest.raises(ValueError):
        compose.tool_search(p, "x", None, "other")


def test_scopes():
    assert compose.scopes_of("all", "g") == ["local", "group", "global"] and compose.scopes_of("odd") == ["local", "global"]
    assert compose.scopes_of("group", "g") == ["group"] and compose.scopes_of("group") == [] and compose.scopes_of("local") == ["local"]


def test_brief_counts_misfits(spark):
    recalled = spark.createDataFrame([(1, "t", "x" * 50, "a.py"), (2, "u", "y" * 5000, ""), (3, "v", "z", None)], "rank int, title string, content string, files string")
    hits = spark.createDataFrame([(1, "a.py", 1, "skipped: a note states the file"), (2, "b.py", 3, "code"), (3, "c.py", 4, "c" * 5000), (4, "d.py", 5, "never looked at")], "rank int, file string, line int, text string")
    noted = spark.createDataFrame([(f, i, "T", "n" * n, "files-field", str(i)) for f, i, n in (("b.py", "m1", 5), ("c.py", "m2", 5), ("c.py", "m1", 5), ("d.py", "m3", 5), ("c.py", "m4", 9000))], "file string, id string, title string, content string, sources string, updated_at string")
    got = compose.brief(recalled, hits, noted, 256).first()
    body = f"[note · files-field · about %s] T\n{'n' * 5}\n\n"
    assert got["text"] == "## Known already\n\n[note] t\n" + "x" * 50 + "\n\n[note] v\nz\n\n## Code\n\n// b.py:3\ncode\n\n## Recorded about this code\n\n" + body % "b.py" + body % "c.py" + "\n3 further item(s) did not fit in 256 tokens.\n"
    assert got["dropped"] == 3 and got["dropped_names"] == ["u", "c.py:4", "T"]
    nothing = compose.brief(recalled.limit(0), hits.limit(0), noted.limit(0), 256).first()
    assert nothing["text"] == "Nothing indexed matched this query.\n"


def test_packed_refuses_long_lists(spark):
    rows = spark.range(12).select(F.lit("g").alias("grp"), F.col("id").alias("rank"), "id", F.lit(10).cast("long").alias("bytes"))
    assert budget.packed(rows, 55).where("taken").count() == 5 and budget.packed(rows, 55, stop=True).where("taken").count() == 5
    with pytest.raises(Exception, match="over 5 blocks"):
        budget.packed(rows, 55, most=5).collect()


def test_fitted_counts_bytes_and_keeps_all_without_a_budget(spark):
    rows = spark.createDataFrame([(k, k, "é" * n) for k, n in enumerate([10, 300, 300, 300, 300])], "id int, rank int, content string")
    assert [r["outcome"] for r in budget.fitted(rows, 640).orderBy("id").collect()] == ["kept", "shortened", "shortened", "shortened", "dropped"]
    assert {r["outcome"] for r in budget.fitted(rows, 0).collect()} == {"kept"}
    short = budget.shortened_note(F.lit("a\nbb\n" + "c" * 900), F.lit(2), F.lit("summary of it"))
    assert one(spark, short) == "summary \n… (summarized)" and one(spark, budget.shortened_note(F.lit("a\nbb\n" + "c" * 900), F.lit(2))) == "a\nbb\n… (shortened)"


def test_backfill(spark):
    notes = spark.createDataFrame([("a", "uses charge here", "pay.py", "r", "m", None), ("b", "see src/pay.py.", "", "r", "m", None), ("c", "x", "gone.py", "r", "m", None), ("d", "x", None, "r", "m", None), ("e", "x", "pay.py", "r", "m", "1")], "id string, content string, files string, repo string, branch string, deleted_at string")
    index = spark.createDataFrame([("src/pay.py", "src/pay.py::charge", 3, "q", "n", False), ("src/pay.py", "src/pay.py::<module>", 1, "q", "n", False)], "file string, symbol string, start_line int, repo string, branch string, is_deletion boolean")
    told, links = memory.backfilled(notes, index, from_text=True)
    assert {r["memory_id"]: (r["outcome"], r["from_text"], r["rows"], r["linked"]) for r in told.collect()} == {"a": ("matched", False, 2, True), "b": ("matched", True, 1, False), "c": ("not_in_repo", False, 0, False), "d": ("without_files", False, 0, False)}
    assert {(r["memory_id"], r["symbol"], r["file"], r["line"], r["repo"], r["source"]) for r in links.collect()} == {("a", "", "src/pay.py", 0, "r", "files-field"), ("a", "src/pay.py::charge", "src/pay.py", 3, "q", "content-mention"), ("b", "", "src/pay.py", 0, "r", "files-field")}
    assert memory.backfill_report(told).first().asDict() == {"examined": 4, "matched": 2, "linked": 1, "rows": 3, "without_files": 1, "from_text": 1, "not_in_repo": 1}
    assert {r["memory_id"]: r["outcome"] for r in memory.backfilled(notes, index)[0].collect()}["b"] == "without_files"


def test_index_runs(spark):
    states = spark.createDataFrame([("r", "main", "a", "1", "m"), ("r", "main", "b", "1", "m"), ("r", "main", "old", "1", "m"), ("r", "dev", "c", "7", "m"), ("r", "dev", "d", "7", "other")], "repo string, branch string, file string, hash string, model string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "7"), ("d", "7"), ("new", "3")], "file string, hash string")
    changed = spark.createDataFrame([("a", "modified", None), ("b", "modified", None), ("c", "added", None), ("d", "added", None), ("new", "renamed", "was"), ("z", "deleted", None)], "file string, status string, from_path string")
    got = {r["file"]: r["outcome"] for r in state.applied_changes(states, changed, now, "r", "main", "m", full=True).collect()}
    assert got == {"a": "skipped", "b": "indexed", "c": "copied", "d": "indexed", "new": "indexed", "was": "renamed", "z": "deleted", "old": "pruned"}
    after, outcomes = watch.incremental(states, spark.createDataFrame([("a",), ("b",), ("old",)], "file string"), now, "r", "main", "m")
    assert {(r["file"], r["hash"]) for r in after.where("branch = 'main'").collect()} == {("a", "1"), ("b", "2")}
    assert state.run_report(outcomes).first().asDict() == {"files_indexed": 1, "files_skipped": 1, "files_deleted": 1, "files_pruned": 0, "files_renamed": 0, "files_copied": 0}
    assert state.next_record({"last_commit": "c1"}, "c2", True, files=3) == {"last_commit": "c1", "files": 3} and state.next_record(None, "c2", True) == {"last_commit": "c2"}
    assert state.index_record(states, "r", "dev").count() == 2


def test_full_or_incremental():
    record = {"model": "m", "dim": 4}
    assert state.needs_full_index(True, None, "m", 4, True) and state.needs_full_index(False, record, "m", 4, True) and state.needs_full_index(True, record, "x", 4, True)
    assert state.needs_full_index(True, record, "m", 8, True) and state.needs_full_index(True, record, "m", 4, False)
    assert not state.needs_full_index(True, record, "m", 4, True) and not state.needs_full_index(False, None, "m", 4, False, explicit_paths=True)
    assert state.default_branch(["x", "master"]) == "master" and state.default_branch(["main", "master"]) == "main" and state.default_branch(["dev"]) is None and state.default_branch(["main"], ["rel"]) == "rel"


def test_registry(spark):
    p = spark.createDataFrame([("a", "/a", "c1", True), ("b", "/b", "c2", False)], "name string, path string, last_commit string, active boolean")
    with pytest.raises(ValueError):
        state.registered(p, spark.createDataFrame([("a", "/other", "", True)], p.schema))
    with pytest.raises(ValueError):
        state.refreshed(p, ["nobody"], p.select("path"))
    heads = spark.createDataFrame([("a", "c9"), ("b", "c9")], "name string, head string")
    seen = []
    assert watch.sweep(p, heads, lambda name, path: seen.append((name, path))) == ["a"] and seen == [("a", "/a")]

    def fails(name, path):
        raise RuntimeError

    assert watch.sweep(p, heads, fails) == []


def test_sweep_stream(spark, tmp_path):
    p = spark.createDataFrame([("a", "/a", "c1", True)], "name string, path string, last_commit string, active boolean")
    heads = spark.createDataFrame([("a", "c9")], "name string, head string")
    seen = []
    q = watch.sweep_stream(spark, lambda: (p, heads), lambda name, path: seen.append(name), "1 second", str(tmp_path))
    for _ in range(60):
        q.awaitTermination(0.5)
        if seen:
            break
    q.stop()
    assert seen and set(seen) == {"a"}


def test_models(spark):
    assert [models.dimension_for(*x) for x in (("local", "bge-base"), ("openai", "large"), ("voyage", "3-lite"), ("local", "unknown"), ("openai", "x"), ("voyage", "x"))] == [768, 3072, 512, 384, 1536, 1024] and models.dimension_for("custom", "x", 99) == 99
    assert models.service_model("openai", "odd") == "text-embedding-3-small" and models.service_model("voyage", "3") == "voyage-3"
    body = '{"data": [{"index": 1, "embedding": [2, 3]}, {"index": 0, "embedding": [0.5]}]}'
    assert one(spark, models.response_vectors(F.lit(body))) == [[0.5], [2.0, 3.0]] and one(spark, models.response_vectors(F.lit('{"vectors": [[1]]}'))) == [[1.0]]
    p = points(spark)
    q = C.similarity([1.0, 0.0])
    odd = p.unionByName(p.limit(1).withColumn("id", F.lit(9)).withColumn("vector", F.lit(None).cast("array<float>"))).unionByName(p.limit(1).withColumn("id", F.lit(8)).withColumn("vector", F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))))
    got = {r["id"]: r["s"] for r in odd.select("id", q(F.col("vector")).alias("s")).collect()}
    assert got[1] == 1.0 and got[9] is None and got[8] == 0.0


def test_import_places(spark):
    d = spark.createDataFrame([("f", '{"id": "a", "project": "p"}\n\n{bad\n{"id": "b", "project": "q"}')], "file string, text string")
    got = {r["destination"]: (r["notes"], [(e["line"], e["value"]) for e in r["errors"]]) for r in tables.grouped_imports(d, "id string, project string").collect()}
    assert got == {"p": (1, []), "q": (1, []), None: (0, [(3, "{bad")])}


def test_rewritten_and_shared_dir(spark, tmp_path):
    spark.range(10).repartition(5).write.parquet(str(tmp_path / "t"))
    assert tables.rewritten(spark, str(tmp_path / "t")).count() == 10 and os.path.isdir(tmp_path / "t")

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_doc_and_block_chunks():
    doc = "# What this does is explained here at some length, for those who read."
    body = "\n".join(f"        value_{k} = compute(value_{k - 1}, {k})" + ("\n" if k % 20 == 0 else "") for k in range(1, 260))
    text = f'class A:\n    # No.\n    def short(self):\n        return 1\n\n    {doc}\n    def long(self, value_0):\n{body}\n'
    got = chunking.file_chunks("a/b.py", text, parsing.parse(text, "python"))
    assert got[0]["text"] == "# File: b.py\n# Imports:\n(none)\n# Symbols:\n- A (class)\n- short (method)\n- long (method)\n" and got[1]["text"] == "class A:\n# methods: short, long"
    docs = [c for c in got if c["level"] == "doc"]
    assert [(d["name"], d["text"], d["start"], d["end"]) for d in docs] == [("long", f"# b.py > A > long\n{doc}\ndef long(self, value_0):", 6, 7)]
    blocks = [c for c in got if c["level"] == "block"]
    assert len(blocks) > 1 and all(c["name"] == "long" and c["text"].startswith("# b.py > A > long\ndef long(self, value_0):\n") for c in blocks)
    assert [b["start"] for b in blocks[1:]] == [a["end"] + 1 for a in blocks[:-1]] and blocks[0]["start"] == 7 and blocks[-1]["end"] == next(s.end for s in parsing.parse(text, "python").symbols if s.name == "long")
    assert next(c for c in got if c["name"] == "short")["text"] == "# b.py > A > short\ndef short(self):\n        return 1"
    assert chunking.grouped_name(["a", "", "b"]) == "a, b +1"


def test_legacy_notes(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "old.db")
    con.execute("CREATE TABLE memories (id INTEGER, deleted_at TEXT, " + ", ".join(f"{f} TEXT" for f in legacy.FIELDS) + ")")
    note = lambda i, deleted, scope, project, topic, repo: (i, deleted, f"t{i}", f"content {i}", "note", scope, project, topic, "", "me", repo, "main", "", f"2024-01-0{i}")
    rows = [note(3, "", "local", "p", None, ""), note(1, None, "Global", "p", "k", "r"), note(2, "2024", "local", "p", "", ""), note(4, None, "local", "", "k", "")]
    con.executemany("INSERT INTO memories VALUES (" + ", ".join("?" * 14) + ")", rows)
    con.commit()
    con.close()
    old = legacy.old_notes(spark, str(tmp_path / "old.db"))
    assert [(r["pos"], r["title"], r["topic_key"]) for r in old.orderBy("pos").collect()] == [(0, "t1", "k"), (1, "t3", ""), (2, "t4", "k")]
    got = {r["title"]: (r["project"], r["repo"]) for r in legacy.migrated(old, "mine", "core", keep_project=True).collect()}
    assert got == {"t1": ("@group:core", "r"), "t3": ("p", "p"), "t4": ("mine", "")}
    assert {r["project"] for r in legacy.migrated(old, "mine").collect()} == {"@global", "mine"}
    saved = memory.remembered(legacy.migrated(old, "mine", keep_project=True))
    assert saved.count() == 3 and {r["revisions"] for r in saved.collect()} == {0}


def test_session_settings():
    assert session.resource_settings(8000, 4) == {"spark.executor.memory": "4800m", "spark.executor.memoryOverhead": "3200m", "spark.executor.cores": "4"}
    assert session.resource_settings(0, 0)["spark.executor.cores"] == "1" and session.shuffle_partitions(100 << 40, 4000) == 819_200 and session.shuffle_partitions(1, 8) == 8


def test_guards(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<float>")
    with pytest.raises(ValueError):
        tables.upserted(v, v, ["id"], 3)
    assert tables.upserted(v, v, ["id"], 2).count() == 1
    for bad in (lambda: models.embedder("x"), lambda: models.reranked(v, "q", 1, "x"), lambda: models.summarizer("x"), lambda: models.summarizer("openai", require_local=True, key="k"), lambda: models.summarizer("openai")):
        with pytest.raises(ValueError):
            bad()
    assert models.summarizer("extractive", require_local=True) == "extractive" and models.summarizer("openai", key="k") == "openai"


def test_search_leaves_notes_out(spark):
    p = points(spark).withColumn("level", F.when(F.col("id") == 1, "memory").otherwise("function"))
    assert [r["id"] for r in compose.tool_search(p, "x", [1.0, 0.0]).collect()] == [3, 2]
    assert [r["id"] for r in compose.tool_search(p, "x", [1.0, 0.0], with_notes=True).collect()] == [1, 3, 2]


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
    ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"),
    ("vietnamization", "vietnam"), ("operator", "oper"), ("hopefulness", "hope"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"),
    ("adoption", "adopt"), ("homologous", "homolog"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("by", "by"),
])
def test_stems(word, stem):
    assert stemmed(word) == stem


def test_analysed_index(spark):
    d = spark.createDataFrame([(1, "The connections were connected"), (2, "a connection, Cafés"), (3, "the cat")], "id long, text string")
    index = retrieval.build_keyword_index(d, Analysis.english(["the", "a", "were"]))
    assert {r["id"] for r in retrieval.bm25_indexed(index, "connecting the").collect()} == {1, 2}
    assert [r["id"] for r in retrieval.bm25_indexed(index, "cafe").collect()] == [2] and retrieval.bm25_indexed(index, "the").count() == 0
    assert {(r["id"], r["term"], r["tf"], r["length"]) for r in index.postings.collect()} == {(1, "connect", 2, 2), (2, "connect", 1, 2), (2, "cafe", 1, 2), (3, "cat", 1, 1)}


def test_index_without_clusters_finds_nine_tenths(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 32)).astype(np.float32)
    v = spark.createDataFrame([(k, x[k].tolist()) for k in range(6000)], "id long, vector array<float>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index = retrieval.build_index(v)
    assert 8 < index.least(5) <= len(index.centroids)
    told = retrieval.recall_of(retrieval.search_index(index, q, 5, 8), retrieval.knn_join(v, q, 5)).agg(F.sum("hits").alias("h"), F.sum("wanted").alias("w")).first()
    assert told["w"] == 1500 and told["h"] >= 1350
    assert retrieval.build_index(v.limit(0)).least(5) == 1 == retrieval.build_index(v.limit(1)).least(5)


def test_nearest_is_the_same_however_rows_are_sliced(monkeypatch):
    r = np.random.default_rng(11)
    x = np.repeat(r.standard_normal((60, 64)), 7, axis=0)[r.permutation(420)]
    q, found = x[:50].copy(), []
    for most in (1, 50 * 13, 1 << 20):
        monkeypatch.setattr(retrieval, "MOST_SCORES", most)
        near = retrieval._Nearest(list(range(50)), q, 5)
        held = []
        for lo in range(0, 420, 100):
            near.add(x[lo : lo + 100], pa.array(range(lo, min(lo + 100, 420))))
            held.append(near.many + (near.held.num_rows if near.held else 0))
        assert max(held) <= 50 * 5 * 3
        found.append([tuple(row.values()) for b in near.batches() for row in b.to_pylist()])
    assert found[0] == found[1] == found[2]
    # Of seven equal vectors those of the least ids come first.
    assert all([i for a, i, _ in found[0] if a == k] == np.flatnonzero((x == q[k]).all(axis=1))[:5].tolist() for k in range(50))


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    d = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "2 5"), (5, "cafe a b c " * 300)], "id long, text string").coalesce(1)
    found = retrieval.postings(d)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 1, 3), (1, "b", 2, 3), *((5, w, 300, 1200) for w in ("a", "b", "c", "cafe"))}
    rows = lambda p: sorted((r["id"], r["term"], r["tf"], r["length"]) for r in p.collect())
    assert rows(found) == sorted(want)
    monkeypatch.setattr(retrieval, "TASK_POSTINGS", 1)
    index = retrieval.build_keyword_index(d)
    assert rows(index.postings) == sorted(want) and index.documents == 5 and index.average == 1203 / 5
    assert rows(retrieval.postings(d, Analysis.english(["a"])))[0] == (1, "b", 2, 2)
