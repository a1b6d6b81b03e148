"""Golden cases of the engine's operators."""

import datetime

from pyspark.sql import functions as F

from corvina.functions import chunking, columns as C, models, parsing
from corvina.operators import budget, graph, memory, predicates, retrieval, state
from corvina.sources import files, tables
from corvina.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vectors_rank_and_filter(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0, 0.0], "rust"), ("b", [0.0, 1.0, 0.0], "python"), ("c", [0.9, 0.1, 0.0], "rust")], "id string, vector array<float>, language string")
    hits = retrieval.knn(p, [1, 0, 0], 2).collect()
    assert [h["id"] for h in hits] == ["a", "c"] and hits[0]["score"] > 0.99
    assert [h["id"] for h in retrieval.knn(p, [1, 0, 0], 2, where=F.col("language") == "python").collect()] == ["b"]


def test_keywords_and_fusion(spark):
    d = spark.createDataFrame([("a", "connect to the postgres database"), ("b", "greet a user by name"), ("c", "database connection pool setup")], "id string, text string")
    assert {h["id"] for h in retrieval.bm25(d, "database connection").collect()} == {"a", "c"}
    one_, two = (spark.createDataFrame([(x, float(-k)) for k, x in enumerate(ids)], "id string, score double") for ids in (["a", "b", "c"], ["b", "d"]))
    fused = retrieval.rrf([one_, two]).collect()
    assert fused[0]["id"] == "b" and len(fused) == 4


def test_impact(spark):
    e = spark.createDataFrame([("a", "b", "calls", "a.rs", 2), ("a", "d", "calls", "a.rs", 3), ("b", "c", "calls", "b.rs", 5)], "source string, target string, kind string, file string, line int")
    got = lambda start, way: {(r["symbol"], r["depth"]) for r in graph.impact(e, start, 5).where(F.col("direction") == way).collect()}
    assert got("c", "up") == {("b", 1), ("a", 2)} and got("a", "down") == {("b", 1), ("d", 1), ("c", 2)}
    twice = spark.createDataFrame([("x", "y", "calls", "f.rs", 1), ("x", "y", "calls", "f.rs", 2)], e.schema)
    assert [r["line"] for r in graph.first_edges(twice).collect()] == [1]


def test_text(spark):
    words = " ".join(f"w{k}" for k in range(12))
    assert one(spark, C.memory_windows(F.lit(words), None, 5, 3)) == ["w3 w4 w5 w6 w7", "w6 w7 w8 w9 w10", "w9 w10 w11"]
    assert one(spark, C.memory_windows(F.lit(words), F.lit("T"), 5, 3))[2] == "T\nw9 w10 w11" and one(spark, C.memory_windows(F.lit("a b"), F.lit("T"))) == []
    assert one(spark, C.sentences(F.lit("Hello world. How are you?\nFine!"))) == ["Hello world.", "How are you?", "Fine!"]
    for text, hit in (("charged", False), ("recharge", False), ("`charge`,", True), ("«charge»", True)):
        assert one(spark, C.mentions(F.lit(text), F.lit("charge"))) is hit
    assert one(spark, C.short_label(F.lit("src/pay.rs::Card.charge"))) == "Card.charge" and one(spark, C.short_label(F.lit("orders/pipeline.rs"))) == "pipeline.rs"
    assert one(spark, C.base_memory_id(F.lit("mem_abc123_c5"))) == "mem_abc123" and one(spark, C.base_memory_id(F.lit("mem_c3abdef"))) == "mem_c3abdef"


def test_remember(spark):
    def run(*rows):
        return memory.remembered(spark.createDataFrame(rows, "project string, topic string, content string, at int")).collect()

    (same,) = run(("p", "", "Hello  there", 1), ("p", "", "hello there", 2))
    assert (same["duplicates"], same["revisions"]) == (1, 0)
    (changed,) = run(("p", "t", "one", 1), ("p", "t", "two", 2))
    assert (changed["revisions"], changed["content"]) == (1, "two")


def test_import_twice(spark):
    rows = spark.createDataFrame([("p", "h1", "", 1), ("p", "h2", "t", 2), ("p", "h3", "t", 3)], "project string, hash string, topic string, pos int")
    first = {r["pos"]: r["outcome"] for r in memory.import_outcomes(rows.limit(0).drop("pos"), rows).collect()}
    assert first == {1: "added", 2: "added", 3: "topic_collision"}
    assert {r["outcome"] for r in memory.import_outcomes(rows.drop("pos"), rows).collect()} == {"present"}


def test_state(spark):
    s = spark.createDataFrame([("r", "main", "a.rs", 3, 7), ("r", "main", "b.rs", 2, 5)], "repo string, branch string, file string, symbols int, chunks int")
    assert [tuple(r)[2:] for r in state.index_totals(s).collect()] == [(2, 5, 12)]
    assert [tuple(r)[2:] for r in state.index_totals(state.without_files(s, s.where("file = 'a.rs'"))).collect()] == [(1, 2, 5)]
    lines = spark.createDataFrame([("A\ta",), ("M\tb",), ("D\tc",), ("R100\td\te",), ("X\tf",)], "value string")
    assert sorted(tuple(r) for r in state.name_status(lines).collect()) == [("added", "a", None), ("deleted", "c", None), ("modified", "b", None), ("renamed", "e", "d")]


def test_files(spark):
    f = spark.createDataFrame([("node_modules/x.js", "a"), ("src/x.min.js", "a"), ("src/a.py", "x=1"), (".git/a.py", ""), ("src/skip/b.py", "")], "file string, text string")
    assert [r["file"] for r in files.indexable(f, ["skip/"]).collect()] == ["src/a.py"]
    assert tables.read_lines(spark.createDataFrame([("f", "1\n2\n3")], "file string, text string"), 2, 3).first()["text"] == "2\n3"


def test_definitions_prefer_exact(spark):
    p = spark.createDataFrame([("1", "A.run", "f", 1, False), ("2", "run", "g", 1, False)], "id string, symbol string, file string, start_line int, is_deletion boolean")
    assert [r["id"] for r in predicates.definitions(p, "run", 5).collect()] == ["2"]


def test_extractive(spark):
    d = spark.createDataFrame([(1, "the weather is fine today indeed. the database is up."), (2, " one sentence only "), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r["summary"] for r in budget.extractive(budget.anchored_sentences(d, models.keyword_embedding, "database"), 6).collect()}
    assert got[1] == "the database is up." and got[2] == "one sentence only" and got[3] == ""


def test_chunks_and_parsing():
    assert chunking.grouped_name([f"f{k}" for k in range(1, 8)]) == "f1, f2, f3, f4 +3"
    got = parsing.parse("class A:\n    def f(self):\n        self.g()\n    def g(self):\n        pass\ndef h(x: A):\n    x.f()\n", "python")
    assert got.edges == [("A.f", "A.g", 3), ("h", "A.f", 7)]
    odd = "from __future__ import annotations\nimport a, b\nx = Late()\n\n# One.\n# Two.\nclass C(Base()):\n    @dec(1)\n    def m(self, y: T, z: U = 1):\n        def inner():\n            y.go()\n            z.go()\n            x.go()\n            self.y.go()\n            super().go()\n        C.D.go(inner)\n"
    got = parsing.parse(odd, "python")
    assert got.imports == ["import a, b"] and [(s.name, s.kind, s.parent, s.doc, s.doc_start) for s in got.symbols] == [("C", "class", "", "# One.\n# Two.", 5), ("m", "method", "C", "@dec(1)", 8), ("inner", "method", "C", "", 10)]
    assert got.edges == [("C.inner", "T.go", 11), ("C.inner", "go", 12), ("C.inner", "go", 13), ("C.inner", "T.go", 14), ("C.inner", "go", 15), ("C.inner", "super", 15), ("C.m", "C.D.go", 16)]
    text = "\n".join(f"line {k} " + "x" * 20 for k in range(400))
    parts = chunking.raw_chunks("a/b.md", text + "\n")
    assert parts[0]["start"] == 1 and parts[-1]["end"] == 400 and all(b["start"] <= a["end"] for a, b in zip(parts, parts[1:]))
    assert chunking.raw_chunks("x", " \n") == [] and {p["name"] for p in parts} == {"b.md"}
    assert chunking.raw_chunks("d/x.md", "one\ntwo\n") == [{"level": "file", "name": "x.md", "start": 1, "end": 2, "text": "one\ntwo\n"}]


def test_routes():
    r = parsing.routes("api.py", "from fastapi import FastAPI\n@app.get('/users')\ndef list_users(): ...\n@app.post('/users')\ndef create_user(): ...\n")
    assert [(x["http_method"], x["path"], x["handler_method"]) for x in r] == [("GET", "/users", "list_users"), ("POST", "/users", "create_user")]
    r = parsing.routes("a.py", "@bp.route('/x', methods=['GET', 'POST'])\ndef x(): ...\n@bp.route('/y', methods=[])\ndef y(): ...")
    assert [(x["http_method"], x["handler_method"]) for x in r] == [("GET", "x"), ("POST", "x"), ("GET", "y")]
    r = parsing.routes("a.js", "app.get('/a',\n  users.list)\nrouter.all(`/b`, check, done)\napp.post('/c', (q, s) => 1)\napi.get('/d', x)\napp.head('/e', x)")
    assert [(x["http_method"], x["path"], x["handler_symbol"], x["handler_method"]) for x in r] == [("GET", "/a", "users.list", "list"), ("ALL", "/b", "check", "check"), ("POST", "/c", "", "")]
    r = parsing.routes("A.java", '@RequestMapping("/api")\nclass A {\n @GetMapping("/b")\n String b() {} }')
    assert (r[0]["path"], r[0]["handler_symbol"]) == ("/api/b", "A.b")


def test_debounce_stream_equals_batch(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([(at(0), "a"), (at(2), "b"), (at(4), "a"), (at(20), "c")], "ts timestamp, path string")
    batch = sorted((r["events"], r["paths"]) for r in watch.debounced(rows, "3 seconds").collect())
    assert batch == [(1, ["c"]), (3, ["a", "b"])]
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    progress = watch.Progress()
    q = watch.indexed_stream(stream, "3 seconds", lambda df, _: got.append(sorted(r["file"] for r in df.collect())), str(tmp_path / "ck"), "1 seconds", progress)
    q.awaitTermination(60)
    assert ["a", "b"] in got and not progress.read()["running"]


def test_extractive_leaves_texts_in_place(spark):
    d = spark.createDataFrame([(1, "the database is up. " + "a. " * 3000 + "the weather is fine today indeed. the database. it"), (1, "the database is up and well here. no. " * 40)], "id int, text string").repartition(2)
    got = budget.extractive(budget.anchored_sentences(d, models.keyword_embedding, "database", digits=9), 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the test's own table: no text is copied or moved for its sentences
    # Sentences of no token are taken while there is room, in the order of their scores, of any number.
    assert sorted(r["summary"] for r in got.collect()) == ["the database is up and well here." + " no." * 40, "the database is up. " + "a. " * 3000 + "the database. it"]
