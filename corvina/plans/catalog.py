"""All queries over the engine's operators, and their SQL forms. Keys follow the blueprint's operator keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C
from corvina.functions import models
from corvina.functions.stemming import Analysis
from corvina.operators import budget, compose, graph, memory, predicates, retrieval, state
from corvina.plans import code_queries
from corvina.plans.projections import frame, oracle
from corvina.sources import files as S
from corvina.sources import tables as T
from corvina.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

QUESTION = "the thing and that within the ereath"
LIVE = "deleted_at IS NULL"


def add(name: str, query: Query, sql: str | None = None, *over: str) -> None:
    _queries[name] = query
    if sql is not None:
        _oracles[name] = oracle(sql, *over) if over else sql


def queries() -> dict[str, Query]:
    return _queries | code_queries.QUERIES


def oracles() -> dict[str, str]:
    return _oracles | code_queries.ORACLES


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: the one of the least id."""
    return frame(spark, d, "vectors").orderBy("id").first()["vector"]


def vector_points(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the vector of the same number, for hybrid search."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return docs.join(frame(spark, d, "vectors"), "id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(vector_points(spark, d), "hybrid", QUESTION, first_vector(spark, d), 10)


def r6(c: str) -> str:
    return f"round({c}, 6) AS {c}"


# --- identities and scalar text functions
DOC = "SELECT doc_id, text FROM documents"
docs = lambda s, d: T.table(s, d, "documents")
add("I1_content_hash", lambda s, d: docs(s, d).select("doc_id", C.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
add("I2_chunk_id", lambda s, d: frame(s, d, "points").select("id", C.chunk_id(F.col("repo"), F.col("branch"), F.col("file"), F.col("start_line"), F.lit(0)).alias("chunk_id")),
    "SELECT id, left(sha256(concat_ws(':', repo, branch, file, start_line, 0)), 32) AS chunk_id FROM points", "points")
NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
add("I3_normalized_hash", lambda s, d: docs(s, d).select("doc_id", C.normalized_hash(F.col("text")).alias("hash")), f"SELECT doc_id, sha256({NORM}) AS hash FROM documents")
add("I4_memory_id", lambda s, d: docs(s, d).select("doc_id", C.memory_id(F.col("source"), C.normalized_hash(F.col("text"))).alias("id")), f"SELECT doc_id, 'mem_' || left(sha256(source || ':' || sha256({NORM})), 24) AS id FROM documents")
add("I5_base_memory_id", lambda s, d: frame(s, d, "memories").select(F.concat("id", F.lit("_c12")).alias("vid"), C.base_memory_id(F.concat("id", F.lit("_c12"))).alias("base")), "SELECT id || '_c12' AS vid, id AS base FROM memories", "memories")
add("I6_identity_project", lambda s, d: docs(s, d).select("doc_id", C.identity_project(F.when(F.col("lang") == "en", "Global").when(F.col("lang") == "fr", "group").otherwise("local"), F.lit("core"), F.col("source")).alias("p")),
    "SELECT doc_id, CASE lang WHEN 'en' THEN '@global' WHEN 'fr' THEN '@group:core' ELSE source END AS p FROM documents")
add("T9_memory_windows", lambda s, d: docs(s, d).select("doc_id", F.posexplode(C.memory_windows(F.col("text"))).alias("pos", "chunk")),
    r"""WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(generate_series(0, 39)) AS pos FROM w) SELECT doc_id, pos::INT AS pos, array_to_string(w[(pos + 1) * 70 + 1 : (pos + 1) * 70 + 100], ' ') AS chunk FROM p WHERE (pos + 1) * 70 < len(w)""")
add("T10_token_estimate", lambda s, d: docs(s, d).select("doc_id", C.token_estimate(F.col("text")).alias("n")), "SELECT doc_id, len(text) // 4 AS n FROM documents")
add("T12_sentences", lambda s, d: docs(s, d).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("pos", "sentence")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("sentence")).alias("chars")),
    r"""SELECT doc_id, count(*) AS n, sum(len(s))::BIGINT AS chars FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(10), 'g'), chr(10))), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM documents) WHERE s <> '' GROUP BY 1""")
PROSE = " see `a/b.rs`. and x.toml, /.py *c/d.scss* «e.xml» f.properties... g.md (h.kt) i.JS src/.ts j.yml:12 a/b.rs"
add("T13_prose_paths", lambda s, d: frame(s, d, "memories").select("id", F.array_join(C.prose_paths(F.concat("files", F.lit(PROSE), "content")), "|").alias("paths")),
    f"""WITH m AS (SELECT id, files || '{PROSE}' || content AS t FROM memories),
    w AS (SELECT id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM (SELECT id, list_transform(string_split_regex(t, '[`"''()\\[\\]{{}},;:<>|*\\s]+'), lambda y: rtrim(y, '.')) AS l FROM m)),
    p AS (SELECT id, x, min(i) AS i FROM w WHERE contains(x, '.') AND regexp_extract(x, '[^.]*$') IN ('java', 'ts', 'tsx', 'js', 'jsx', 'html', 'scss', 'css', 'py', 'rs', 'go', 'sql', 'yaml', 'yml', 'xml', 'properties', 'kt')
      AND length(regexp_replace(x, '\\.[^.]*$', '')) > 0 AND NOT suffix(regexp_replace(x, '\\.[^.]*$', ''), '/') GROUP BY id, x)
    SELECT m.id, coalesce(string_agg(x, '|' ORDER BY i), '') AS paths FROM m LEFT JOIN p ON m.id = p.id GROUP BY m.id""".replace("\\\\", "\\"), "memories")
add("T11_F9_labels", lambda s, d: frame(s, d, "points").select("id", C.short_label(F.col("symbol")).alias("label"), C.basename(F.col("file")).alias("base"), C.context_header(F.col("file"), F.col("language"), C.short_label(F.col("symbol"))).alias("header")),
    "SELECT id, CASE WHEN symbol = '' THEN '' ELSE split_part(symbol, '::', 2) END AS label, split_part(file, '/', 2) AS base, '# ' || split_part(file, '/', 2) || ' > ' || language || CASE WHEN symbol = '' THEN '' ELSE ' > ' || split_part(symbol, '::', 2) END AS header FROM points", "points")
add("F7_mentions", lambda s, d: docs(s, d).select("doc_id", *(C.mentions(F.lower("text"), F.lit(w)).alias(w) for w in ("the", "that", "la"))),
    "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') AS {w}" for w in ("the", "that", "la")) + " FROM documents")
add("F10_synthetic", lambda s, d: frame(s, d, "points").select("id", "symbol", F.explode(F.array(F.lit(""), F.lit("a::<module>"), F.lit("src/<anonymous>"), F.lit("<unknown>"), F.lit("<unknown>x"), F.lit("<module>::b"))).alias("more")).select("id", "more", C.synthetic(F.concat("symbol", "more")).alias("synthetic")),
    """SELECT id, more, CASE WHEN contains(x, '::') THEN regexp_extract(x, '::((?:[^:]|:[^:])*)$', 1) WHEN contains(x, '/') THEN regexp_extract(x, '[^/]*$') ELSE x END IN ('<unknown>', '<module>', '<anonymous>') AS synthetic
    FROM (SELECT id, more, symbol || more AS x FROM points, (SELECT unnest(['', 'a::<module>', 'src/<anonymous>', '<unknown>', '<unknown>x', '<module>::b']) AS more))""", "points")
NAMES = ["py", "PY", "mjs", "tsx", "d.ts", "java", "rs", "go", "md", "kts", "scss", "htm", "yml", "proto", "txt", "", "gql", "pyi", "cts"]
add("S6_S7_languages", lambda s, d: docs(s, d).select("doc_id", F.concat(F.lit("src.d/f."), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))).alias("file")).select("doc_id", C.language_of(F.col("file"), C.PARSED).alias("parsed"), C.language_of(F.col("file"), C.RAW).alias("raw")),
    f"""SELECT doc_id, CASE WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'mjs' THEN 'javascript' WHEN e = 'tsx' THEN 'tsx' WHEN e IN ('ts', 'cts') THEN 'typescript' WHEN e = 'java' THEN 'java' WHEN e = 'rs' THEN 'rust' WHEN e = 'go' THEN 'go' END AS parsed,
    CASE e WHEN 'md' THEN 'markdown' WHEN 'kts' THEN 'kotlin' WHEN 'scss' THEN 'scss' WHEN 'htm' THEN 'html' WHEN 'yml' THEN 'yaml' WHEN 'proto' THEN 'protobuf' WHEN 'gql' THEN 'graphql' END AS raw
    FROM (SELECT doc_id, regexp_extract(lower(list_extract({NAMES}, (doc_id % {len(NAMES)} + 1)::INT)), '[^.]*$') AS e FROM documents)""")
add("S8_excluded", lambda s, d: frame(s, d, "points").where(~S.excluded(F.col("file"), ["src1*/", "*.py", "!src2/*.py", "#x"])).groupBy("repo").agg(F.count("*").alias("n")), "SELECT repo, count(*) AS n FROM points WHERE repo = 'src2' GROUP BY 1", "points")
PATHS = ["a/x.py", ".git/x", "a/.git/x", ".fastembed_cache/m", "node_modules/x.js", "a/vendor/b.go", "third_party/x.c", "a/dist/x.js", "a/bower_components/y/x.js", "build/x.java", "target/x.rs", "a/x.min.js", "x.bundle.css", "package-lock.json", "x-lock.json.py", "x.min.d/y.py", "a/dist"]
add("S9_S10_indexable", lambda s, d: docs(s, d).select("doc_id", "text", F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int")).alias("p")).select("doc_id", C.own_artifact(F.col("p")).alias("own"), C.generated(F.col("p"), F.col("text")).alias("generated")),
    f"""SELECT doc_id, split_part(p, '/', 1) IN ('.corvina', '.fastembed_cache', '.git') AS own, list_has_any(string_split(p, '/'), ['node_modules', 'vendor', 'third_party', 'dist', 'bower_components']) OR contains(n, '.min.') OR contains(n, '.bundle.') OR suffix(n, '-lock.json')
    OR len(list_filter(string_split(text, chr(10)), lambda x: strlen(rtrim(x, chr(13))) > 1000)) > 0 AS generated FROM (SELECT doc_id, text, p, regexp_extract(p, '[^/]*$') AS n FROM (SELECT *, list_extract({PATHS}, (doc_id % {len(PATHS)} + 1)::INT) AS p FROM documents))""")
add("T23_joined_path", lambda s, d: frame(s, d, "routes").select("line", C.joined_path(F.lit("/api/"), F.col("path")).alias("path")), "SELECT line, '/api' || CASE WHEN trim(path, '/') = '' THEN '' ELSE '/' || trim(path, '/') END AS path FROM routes", "routes")
add("T28_noop_summary", lambda s, d: docs(s, d).select("doc_id", C.noop_summary(F.col("text"), 50).alias("summary")), r"SELECT doc_id, CASE WHEN len(t) <= 200 THEN t ELSE left(t, 200) || '…' END AS summary FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)")
add("T25_keyword_embedding", lambda s, d: docs(s, d).select("doc_id", F.array_join(F.transform(models.keyword_embedding(F.col("text"), ("the", "la", "der")), lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), ",").alias("v")),
    """SELECT doc_id, array_to_string(list_transform(h, lambda x: CASE WHEN list_sum(h) > 0 THEN round(x / sqrt(list_sum(h)) * 10000)::INT ELSE 0 END), ',') AS v FROM (SELECT doc_id, [contains(lower(text), 'the')::INT, contains(lower(text), 'la')::INT, contains(lower(text), 'der')::INT] AS h FROM documents)""")
add("X8_decoded_vector", lambda s, d: frame(s, d, "vectors").select("id", F.posexplode(models.decoded_vector(F.transform("vector", lambda x, i: F.when((i + F.col("id")) % 7 != 0, x)))).alias("pos", "x")).select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x")),
    "SELECT id, (i - 1)::INT AS pos, round(CASE WHEN (i - 1 + id) % 7 <> 0 THEN vector[i]::DOUBLE ELSE 0 END, 6) AS x FROM (SELECT id, vector, unnest(generate_series(1, len(vector))) AS i FROM vectors)", "vectors")
add("X7_response_vectors", lambda s, d: docs(s, d).select("doc_id", models.response_vectors(F.when(F.col("doc_id") % 2 == 0, F.format_string('{"data": [{"index": 1, "embedding": [%d, 0.5]}, {"index": 0, "embedding": [1.5, 2]}], "model": "m"}', "doc_id")).otherwise(F.format_string('{"vectors": [[%d], [3]]}', "doc_id"))).alias("v")).select("doc_id", F.size("v").alias("n"), F.flatten("v").alias("x")).select("doc_id", "n", F.array_join(F.transform("x", lambda x: F.round(x.cast("double") * 10).cast("long").cast("string")), ",").alias("x")),
    "SELECT doc_id, 2 AS n, CASE WHEN doc_id % 2 = 0 THEN '15,20,' || doc_id * 10 || ',5' ELSE doc_id * 10 || ',30' END AS x FROM documents")

# --- sources and sinks
LETTERS = ["A", "M", "D", "T", "X", "R100", "C75"]
add("S4_name_status", lambda s, d: state.name_status(frame(s, d, "points").select(F.concat_ws("\t", F.element_at(F.array(*map(F.lit, LETTERS)), (F.length("text") % 7 + 1).cast("int")), "file", F.when(F.length("text") % 7 >= 5, F.concat(F.lit("new/"), "file"))).alias("value"))).groupBy("status", "path", "from_path").agg(F.count("*").alias("n")),
    """SELECT CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'modified' WHEN 5 THEN 'renamed' ELSE 'added' END AS status, CASE WHEN k >= 5 THEN 'new/' || file ELSE file END AS path, CASE WHEN k = 5 THEN file END AS from_path, count(*) AS n
    FROM (SELECT file, length(text) % 7 AS k FROM points) WHERE k <> 4 GROUP BY ALL""", "points")
add("S11_scroll", lambda s, d: predicates.scrolled(frame(s, d, "points"), (F.col("repo") == "src3") & (F.col("branch") == "en"), ["id", "file"]), "SELECT id, file FROM points WHERE repo = 'src3' AND branch = 'en'", "points")
add("S11_scroll_page", lambda s, d: predicates.scrolled(frame(s, d, "points"), F.col("language") == "en", ["id", "file", "start_line"], after=("src3", 5, ""), limit=25, order=("file", "start_line", "id")), "SELECT id, file, start_line FROM points WHERE language = 'en' AND (file, start_line, id) > ('src3', 5, '') ORDER BY file, start_line, id LIMIT 25", "points")
add("S12_vector_by_id", lambda s, d: predicates.vector_by_id(frame(s, d, "vectors"), [7, 11]).select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("x")), "SELECT id, round(vector[1]::DOUBLE, 6) AS x FROM vectors WHERE id IN (7, 11)", "vectors")
add("S13_upsert", lambda s, d: T.upserted(frame(s, d, "vectors").select("id", "vector", "label"), frame(s, d, "vectors").where("label = 3").select((F.col("id") + 250).alias("id"), "vector", F.lit(99).alias("label")), ["id"], 64).select("id", "label"),
    "SELECT id, label FROM vectors WHERE id NOT IN (SELECT id + 250 FROM vectors WHERE label = 3) UNION ALL SELECT id + 250, 99 FROM vectors WHERE label = 3", "vectors")
add("S14_transfer", lambda s, d: T.import_lines(T.export_lines(frame(s, d, "memories").select("id", "project", "content"), "@global"), "id string, project string, content string").select("id", "project", "content", F.col("corrupt").isNull().alias("good")),
    "SELECT id, project, content, true AS good FROM memories WHERE project = '@global'", "memories")


def transferred(s, d):
    """Files of five JSON lines, of which some do not parse and some are blank."""
    number = F.col("vec_id").cast("string")
    line = F.when(F.col("vec_id") % 11 == 3, "{broken").when(F.col("vec_id") % 13 == 0, "").otherwise(F.concat(F.lit('{"id": "m'), number, F.lit('", "project": "p'), (F.col("vec_id") % 3).cast("string"), F.lit('"}')))
    rows = T.table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("file"), F.struct("vec_id", line.alias("line")).alias("x"))
    texts = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    done = T.grouped_imports(texts, "id string, project string")
    return done.select("file", "destination", "notes", F.array_join(F.transform("errors", lambda e: F.concat(e["line"].cast("string"), F.lit(":"), e["value"])), "|").alias("errors"))


add("S15_grouped_import", transferred,
    """SELECT file, destination, count(*) FILTER (WHERE destination IS NOT NULL) AS notes, coalesce(string_agg(line || ':{broken', '|' ORDER BY line) FILTER (WHERE destination IS NULL), '') AS errors FROM
    (SELECT vec_id // 5 AS file, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS line, CASE WHEN vec_id % 11 <> 3 THEN 'p' || vec_id % 3 END AS destination, vec_id % 13 = 0 AND vec_id % 11 <> 3 AS blank FROM embeddings) WHERE NOT blank GROUP BY 1, 2""")
add("S17_read_lines", lambda s, d: T.read_lines(docs(s, d).select(F.col("doc_id").alias("file"), "text"), 2, 3), "SELECT doc_id AS file, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS text FROM documents")
add("S17_capped_file", lambda s, d: T.capped_lines(docs(s, d).select(F.col("doc_id").alias("file"), "text"), 200),
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents),
    c AS (SELECT *, sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l)
    SELECT doc_id AS file, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE b <= 800 OR i = 1) AS text, count(*) FILTER (WHERE NOT (b <= 800 OR i = 1)) AS missing FROM c GROUP BY 1""")

# --- filters
add("F1_point_filter", lambda s, d: frame(s, d, "points").where(predicates.point_filter(repo="src0", languages=["fr", "de"], levels=["function"])).select("id", "file", "language"), "SELECT id, file, language FROM points WHERE repo = 'src0' AND language IN ('fr', 'de') AND level = 'function' AND NOT is_deletion", "points")


def narrowed(s, d):
    p = frame(s, d, "points")
    branch = predicates.narrowed_branch(p, "src0", "gone", "fr")
    return p.where(predicates.point_filter(repo="src0", branch=branch)).select("id", "branch")


add("F2_branch_narrowing", narrowed, "SELECT id, branch FROM points WHERE repo = 'src0' AND branch = 'fr' AND NOT is_deletion", "points")
add("F3_search_routes", lambda s, d: predicates.search_routes(frame(s, d, "routes"), "get", "en/").select("http_method", "path", "line"), "SELECT http_method, path, line FROM routes WHERE upper(http_method) = 'GET' AND contains(path, 'en/')", "routes")
add("F4_routes_for_handler", lambda s, d: predicates.routes_for_handler(frame(s, d, "routes"), "page7").select("path", "handler_symbol", "line"), "SELECT path, handler_symbol, line FROM routes WHERE handler_symbol = 'page7' OR handler_method = 'page7'", "routes")
add("F5_definitions", lambda s, d: predicates.definitions(frame(s, d, "points"), "charge3", 5, "src3", "en").select("id", "symbol", "tier"), "SELECT id, symbol, 2 AS tier FROM points WHERE repo = 'src3' AND branch = 'en' AND NOT is_deletion AND suffix(symbol, '.charge3') ORDER BY file, start_line, id LIMIT 5", "points")
add("F5_exact_definitions", lambda s, d: predicates.definitions(frame(s, d, "points"), "src3::Card3.charge3", 5).select("id", "symbol", "tier"), "SELECT id, symbol, 1 AS tier FROM points WHERE NOT is_deletion AND symbol = 'src3::Card3.charge3' ORDER BY file, start_line, id LIMIT 5", "points")
add("F6_mentioning", lambda s, d: predicates.mentioning(frame(s, d, "memories"), "ouche", 20).select("id", "updated_at"), f"SELECT id, updated_at FROM memories WHERE {LIVE} AND (contains(content, 'ouche') OR contains(files, 'ouche')) ORDER BY updated_at DESC, id LIMIT 20", "memories")
add("F8_hit_projection", lambda s, d: predicates.hits(frame(s, d, "points")), "SELECT id, file, start_line, symbol, level, text FROM points WHERE NOT is_deletion", "points")
add("F11_shared_memories", lambda s, d: predicates.shared_memories(frame(s, d, "memories")).select("id", "project"), f"SELECT id, project FROM memories WHERE {LIVE} AND (project = '@global' OR starts_with(project, '@group:'))", "memories")
add("F12_stale_projects", lambda s, d: predicates.stale_projects(frame(s, d, "projects"), frame(s, d, "heads")).select("name"), "SELECT p.name FROM projects p JOIN heads h ON p.name = h.name WHERE active AND head <> last_commit", "projects", "heads")
add("F13_tracked", lambda s, d: frame(s, d, "states").where(predicates.tracked(F.col("branch"), ["en", "fr"])).groupBy("branch").agg(F.count("*").alias("n")), "SELECT branch, count(*) AS n FROM states WHERE branch IN ('en', 'fr') GROUP BY 1", "states")

# --- aggregates
add("A1_count", lambda s, d: frame(s, d, "points").where(predicates.point_filter(languages=["en"])).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM points WHERE language = 'en' AND NOT is_deletion", "points")
add("A2_index_totals", lambda s, d: state.index_totals(frame(s, d, "states")), "SELECT repo, branch, count(*) AS files, coalesce(sum(symbols), 0)::BIGINT AS symbols, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM states GROUP BY 1, 2", "states")
add("A3_memory_stats", lambda s, d: memory.stats(frame(s, d, "memories")), f"SELECT memory_type, count(*) AS n FROM memories WHERE {LIVE} GROUP BY ROLLUP (memory_type)", "memories")
add("A4_G1_callers", lambda s, d: graph.callers(frame(s, d, "edges"), "p5"), "SELECT DISTINCT source AS symbol FROM edges WHERE target = 'p5'", "edges")
add("A4_G1_callees", lambda s, d: graph.callees(frame(s, d, "edges"), "p5"), "SELECT DISTINCT target AS symbol FROM edges WHERE source = 'p5'", "edges")
add("A5_defined_symbols", lambda s, d: frame(s, d, "edges").select("source").distinct(), "SELECT DISTINCT source FROM edges", "edges")
add("A6_files_branches", lambda s, d: frame(s, d, "points").where("NOT is_deletion AND file <> ''").select("file", "branch").distinct(), "SELECT DISTINCT file, branch FROM points WHERE NOT is_deletion AND file <> ''", "points")
add("A8_best_by_level", lambda s, d: frame(s, d, "points").groupBy("file").agg(F.max(F.when(F.col("level") == "file", F.length("text"))).alias("intro"), F.max(F.when(F.col("level") == "function", F.length("text"))).alias("body")).withColumn("score", C.blend(F.col("intro"), F.col("body"))),
    "SELECT *, coalesce((intro + body) / 2, intro, body)::DOUBLE AS score FROM (SELECT file, max(length(text)) FILTER (WHERE level = 'file')::INT AS intro, max(length(text)) FILTER (WHERE level = 'function')::INT AS body FROM points GROUP BY 1)", "points")
add("A9_branch_exists", lambda s, d: frame(s, d, "points").groupBy("repo").agg((F.count_if(F.col("branch") == "es") > 0).alias("found")), "SELECT repo, count(*) FILTER (WHERE branch = 'es') > 0 AS found FROM points GROUP BY 1", "points")
add("A10_symbols_per_file", lambda s, d: state.symbols_per_file(frame(s, d, "points")), "SELECT file, count(DISTINCT CASE WHEN symbol <> '' THEN symbol END) AS symbols, count(*) AS chunks FROM points GROUP BY 1", "points")

# --- sorts and limits
add("L3_G4_edge_export", lambda s, d: graph.export(frame(s, d, "edges"), kind="calls", file="s3").select("source", "target", "line"), "SELECT source, target, line FROM edges WHERE kind = 'calls' AND file = 's3' ORDER BY source, target, kind, file, line LIMIT 2000", "edges")
add("L4_G2_references", lambda s, d: graph.references(frame(s, d, "edges"), "p9").select("source", "file", "line"), "SELECT source, file, line FROM edges WHERE target = 'p9'", "edges")
add("L5_recent_memories", lambda s, d: frame(s, d, "memories").where(LIVE).orderBy(F.desc("updated_at"), "id").limit(20).select("id"), f"SELECT id FROM memories WHERE {LIVE} ORDER BY updated_at DESC, id LIMIT 20", "memories")
add("L6_all_memories", lambda s, d: frame(s, d, "memories").orderBy("created_at", "id").select("id", "created_at"), "SELECT id, created_at FROM memories", "memories")
add("L7_newest_by_topic", lambda s, d: predicates.latest_by(frame(s, d, "memories").where("topic <> ''"), ["project", "topic"], [F.desc("updated_at"), F.col("id")]).select("project", "topic", "id"),
    "SELECT project, topic, id FROM (SELECT *, row_number() OVER (PARTITION BY project, topic ORDER BY updated_at DESC, id) AS k FROM memories WHERE topic <> '') WHERE k = 1", "memories")
add("L9_projects", lambda s, d: frame(s, d, "projects").where("active").orderBy("name").select("name", "path"), "SELECT name, path FROM projects WHERE active", "projects")
add("L10_merged_recent", lambda s, d: memory.merged_recent(frame(s, d, "memories").where(f"{LIVE} AND project = 'proj1'"), predicates.shared_memories(frame(s, d, "memories")), 20).select("id"),
    f"SELECT id FROM memories WHERE {LIVE} AND (project = 'proj1' OR project = '@global' OR starts_with(project, '@group:')) ORDER BY updated_at DESC, id LIMIT 20", "memories")

# --- joins
noted = lambda s, d: frame(s, d, "memories").withColumn("content", F.concat("content", F.lit(" (Card1.charge1, Card2.charge2x) `Card3.charge3`; «Card4.charge4» éCard5.charge5")))
add("J1_memories_by_id", lambda s, d: memory.by_ids(frame(s, d, "memories").select("id"), frame(s, d, "memories").where("memory_type = 'user'"), frame(s, d, "memories")).select("id", "memory_type"), f"SELECT id, memory_type FROM memories WHERE {LIVE}", "memories")
J3 = f"""SELECT m.id AS memory_id, p.symbol, m.file, min(p.line) AS line FROM (SELECT DISTINCT id, content || ' (Card1.charge1, Card2.charge2x) `Card3.charge3`; «Card4.charge4» éCard5.charge5' AS content, trim(unnest(string_split(files, ','))) AS file FROM memories WHERE {LIVE}) m
 JOIN (SELECT file, symbol, split_part(symbol, '::', 2) AS label, start_line AS line FROM points WHERE NOT is_deletion AND symbol <> '') p ON m.file = p.file WHERE regexp_matches(m.content, '(^|[^A-Za-z0-9_])' || replace(p.label, '.', '[.]') || '($|[^A-Za-z0-9_])') GROUP BY 1, 2, 3"""
add("J3_M7_mentioned_symbols", lambda s, d: memory.mentioned_symbols(noted(s, d), frame(s, d, "points")).select("memory_id", "symbol", "file", "line"), J3, "memories", "points")
add("J4_resolved_files", lambda s, d: memory.resolved_files(frame(s, d, "points").select(F.col("file").alias("path")).unionByName(frame(s, d, "points").select(C.basename(F.col("file")).alias("path"))), frame(s, d, "points").select("file")),
    """SELECT path, min(file) AS file FROM (SELECT file AS path, file FROM points UNION SELECT split_part(file, '/', 2) AS path, any_value(file) FROM (SELECT DISTINCT file FROM points) GROUP BY 1 HAVING count(*) = 1) GROUP BY 1""", "points")
deep = lambda s, d: frame(s, d, "points").select(F.concat(F.lit("root/"), "file").alias("file")).distinct()
add("J4_suffixes", lambda s, d: memory.resolved_files(frame(s, d, "points").select(F.col("file").alias("path")).unionByName(frame(s, d, "points").select(F.concat(F.lit("1/"), C.basename(F.col("file"))).alias("path"))), deep(s, d).unionByName(deep(s, d).where("file < 'root/src15'").select(F.concat(F.lit("other/"), "file").alias("file")))),
    "SELECT DISTINCT file AS path, 'root/' || file AS file FROM points WHERE 'root/' || file >= 'root/src15'", "points")
add("J5_M5_purge", lambda s, d: memory.without_project(frame(s, d, "memories").select(F.concat("id", F.lit("_c3")).alias("id")), frame(s, d, "memories"), "proj2"), "SELECT id || '_c3' AS id FROM memories WHERE project <> 'proj2'", "memories")
SNAP = "SELECT file, hash FROM (SELECT file, max(hash) AS hash FROM states GROUP BY 1)"
snapshot = lambda s, d: frame(s, d, "states").groupBy("file").agg(F.max("hash").alias("hash"))
later = lambda s, d: snapshot(s, d).where("hash <> '6'").select(F.when(F.col("hash") == "5", F.concat("file", F.lit(".new"))).otherwise(F.col("file")).alias("file"), F.when(F.col("hash") == "4", "x").otherwise(F.col("hash")).alias("hash"))
add("J6_pruned_files", lambda s, d: state.pruned(snapshot(s, d), later(s, d)), f"SELECT file FROM ({SNAP}) WHERE hash IN ('5', '6')", "states")
add("J7_untracked_branches", lambda s, d: state.untracked_branches(frame(s, d, "states"), ["fr"], "en"), "SELECT DISTINCT branch FROM states WHERE branch NOT IN ('fr', 'en')", "states")
add("J8_changes", lambda s, d: state.changes(snapshot(s, d), later(s, d)), f"SELECT file, CASE WHEN hash IN ('5', '6') THEN 'deleted' WHEN hash = '4' THEN 'modified' ELSE 'unchanged' END AS status FROM ({SNAP}) UNION ALL SELECT file || '.new', 'added' FROM ({SNAP}) WHERE hash = '5'", "states")
add("J9_copy_sources", lambda s, d: state.copy_sources(frame(s, d, "states").select("file", "branch", "hash", "model").distinct(), "en"),
    "SELECT a.file, a.hash, min(b.branch) AS from_branch FROM (SELECT DISTINCT file, hash FROM states WHERE branch = 'en') a JOIN states b ON a.file = b.file AND a.hash = b.hash AND b.branch <> 'en' GROUP BY 1, 2", "states")
add("J10_untracked_paths", lambda s, d: frame(s, d, "points").select("file").distinct().join(frame(s, d, "points").where("language = 'de'").select("file"), "file", "left_anti"), "SELECT DISTINCT file FROM points WHERE file NOT IN (SELECT file FROM points WHERE language = 'de')", "points")
add("J11_external_targets", lambda s, d: graph.assembled_nodes(frame(s, d, "edges")).select("id", "external"), "SELECT id, max(s) = 0 AS external FROM (SELECT source AS id, 1 AS s FROM edges UNION ALL SELECT target, 0 FROM edges) GROUP BY 1", "edges")
hashes = lambda s, d: docs(s, d).select(F.col("source").alias("project"), C.normalized_hash(F.col("text")).alias("hash"), F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("t"), (F.col("doc_id") % 9).cast("string"))).otherwise("").alias("topic"), F.col("doc_id").alias("pos"), "lang")
IMPORT = f"""WITH h AS (SELECT source AS project, sha256({NORM}) AS hash, CASE WHEN n_chars % 3 = 0 THEN 't' || (doc_id % 9) ELSE '' END AS topic, doc_id AS pos, lang FROM documents),
i AS (SELECT *, hash IN (SELECT e.hash FROM h e WHERE e.lang = 'fr' AND e.project = h.project) OR row_number() OVER (PARTITION BY project, hash ORDER BY pos) > 1 AS present FROM h WHERE lang <> 'fr' OR lang = 'fr')
SELECT pos, CASE WHEN present THEN 'present' WHEN topic <> '' AND (topic IN (SELECT e.topic FROM h e WHERE e.lang = 'fr' AND e.project = i.project)
 OR coalesce(max(CASE WHEN NOT present AND topic <> '' THEN 1 END) OVER (PARTITION BY project, topic ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) THEN 'topic_collision' ELSE 'added' END AS outcome FROM i"""
add("J12_M11_import", lambda s, d: memory.import_outcomes(hashes(s, d).where("lang = 'fr'").select("project", "hash", "topic"), hashes(s, d).select("project", "hash", "topic", "pos")).select("pos", "outcome"), IMPORT)

# --- retrieval
COS = "list_cosine_similarity(vector::DOUBLE[], (SELECT vector::DOUBLE[] FROM vectors ORDER BY id LIMIT 1))"
add("V1_L1_cosine_knn", lambda s, d: retrieval.knn(frame(s, d, "vectors"), first_vector(s, d), 10, where=F.col("label").isin(1, 2, 3, 4, 5)).selectExpr("id", r6("score")), f"SELECT id, round({COS}, 6) AS score FROM vectors WHERE label IN (1, 2, 3, 4, 5) ORDER BY {COS} DESC, id LIMIT 10", "vectors")
add("V2_inner_product_knn", lambda s, d: retrieval.knn(frame(s, d, "vectors"), first_vector(s, d), 10, metric="ip").selectExpr("id", r6("score")), f"SELECT id, round({COS.replace('cosine_similarity', 'inner_product')}, 6) AS score FROM vectors ORDER BY {COS.replace('cosine_similarity', 'inner_product')} DESC, id LIMIT 10", "vectors")
every_20th = lambda s, d: frame(s, d, "vectors").where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
add("J13_knn_join", lambda s, d: retrieval.knn_join(frame(s, d, "vectors"), every_20th(s, d), 5).select("query_id", "id", F.col("rank").cast("long").alias("rank")),
    """SELECT query_id, id, rank FROM (SELECT q.id AS query_id, v.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(v.vector::DOUBLE[], q.vector::DOUBLE[]) DESC, v.id) AS rank
    FROM vectors v, (SELECT * FROM vectors WHERE id % 20 = 0) q) WHERE rank <= 5""", "vectors")


def index_recall(s, d):
    """Queries of every 20th vector against the index, and whether nine tenths of the exact neighbours are found in all."""
    v = frame(s, d, "vectors")
    found = retrieval.search_index(retrieval.build_index(v), every_20th(s, d), 5, INDEX_PROBES)
    told = retrieval.recall_of(found, retrieval.knn_join(v, every_20th(s, d), 5))
    return told.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("enough"))


INDEX_PROBES = 16
add("V2b_index_recall", index_recall, "SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS enough FROM vectors WHERE id % 20 = 0", "vectors")
TERMS = sorted(set(QUESTION.split()))
BM = f"""w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
 c AS (SELECT id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS))} FROM w),
 a AS (SELECT count(*) AS nd, avg(n) AS av, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(TERMS)))} FROM c),
 bm AS (SELECT id, {' + '.join(f'CASE WHEN t{i} > 0 THEN ln((nd - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / av)) ELSE 0 END' for i in range(len(TERMS)))} AS score FROM c, a)"""
add("V3_L2_bm25", lambda s, d: retrieval.bm25(docs(s, d).select(F.col("doc_id").alias("id"), "text"), QUESTION, 20).selectExpr("id", r6("score")), f"WITH {BM} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
add("V3b_postings", lambda s, d: retrieval.postings(docs(s, d).select(F.col("doc_id").alias("id"), "text")).groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens")),
    "WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents) SELECT id, len(list_distinct(w)) AS terms, len(w) AS tokens FROM w WHERE len(w) > 0")
HYBRID = f"""vectors AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), {BM}, near AS (SELECT id, row_number() OVER (ORDER BY {COS} DESC, id) AS r FROM vectors WHERE id IN (SELECT doc_id FROM documents)),
 words AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm WHERE score > 0 AND id IN (SELECT id FROM vectors)),
 fused AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM near WHERE r <= 20 UNION ALL SELECT * FROM words WHERE r <= 20) GROUP BY 1)"""
HYBRID = HYBRID.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))", 1)
add("V4_V5_hybrid_search", lambda s, d: flagship(s, d).select("id", F.round("score", 6).alias("score")), f"WITH {HYBRID} SELECT id, round(score, 6) AS score FROM fused ORDER BY score DESC, id LIMIT 10")
add("V6_T27_rerank", lambda s, d: models.reranked(retrieval.bm25(docs(s, d).select(F.col("doc_id").alias("id"), "text"), QUESTION, 20).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id"), QUESTION, 10).select("id", "score"),
    f"WITH {BM} SELECT id, (21 - row_number() OVER (ORDER BY score DESC, id))::DOUBLE AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, id LIMIT 10")
tool_points = lambda s, d: vector_points(s, d).select("id", "text", F.col("lang").alias("language"), "vector", (F.char_length("text") < 200).alias("is_deletion"))
HYBRID_SOURCES = "vectors AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), docs AS (SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"
ALLOWED = "SELECT doc_id FROM docs WHERE length(text) >= 200 AND lang = 'en'"
add("T27_lexical_rerank", lambda s, d: models.reranked(retrieval.bm25(docs(s, d).select(F.col("doc_id").alias("id"), "text"), QUESTION, 20).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id"), QUESTION, 10, "lexical").select("id", "score"),
    f"WITH {BM}, top AS (SELECT id FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20) SELECT id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\W+')), {sorted(set(QUESTION.lower().split()))}))::DOUBLE AS score FROM top JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 10")
add("V3b_V7_tool_keyword", lambda s, d: compose.tool_search(tool_points(s, d), QUESTION, None, "keyword", 10, "en", rerank="lexical").select("id", F.round("score", 6).alias("score"), "score_kind"),
    f"WITH {HYBRID_SOURCES}, {BM.replace('FROM documents', 'FROM docs')} SELECT id, round(score, 6) AS score, 'bm25' AS score_kind FROM bm WHERE score > 0 AND id IN ({ALLOWED}) ORDER BY bm.score DESC, id LIMIT 10")
add("V7_tool_hybrid", lambda s, d: compose.tool_search(tool_points(s, d), QUESTION, first_vector(s, d), "hybrid", 10, "en").select("id", F.round("score", 6).alias("score"), "score_kind"),
    f"""WITH {HYBRID_SOURCES}, {BM.replace('FROM documents', 'FROM docs')}, near AS (SELECT id, row_number() OVER (ORDER BY {COS} DESC, id) AS r FROM vectors WHERE id IN ({ALLOWED})),
    words AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm WHERE score > 0 AND id IN ({ALLOWED})),
    fused AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM near WHERE r <= 20 UNION ALL SELECT * FROM words WHERE r <= 20) GROUP BY 1)
    SELECT id, round(score, 6) AS score, 'rrf' AS score_kind FROM fused ORDER BY fused.score DESC, id LIMIT 10""")
add("V7_tool_vector_reranked", lambda s, d: compose.tool_search(tool_points(s, d), QUESTION, first_vector(s, d), "vector", 10, None, rerank="noop").select("id", "score", "score_kind"),
    f"WITH {HYBRID_SOURCES} SELECT id, (21 - row_number() OVER (ORDER BY {COS} DESC, id))::DOUBLE AS score, 'noop' AS score_kind FROM vectors WHERE id IN (SELECT doc_id FROM docs WHERE length(text) >= 200) ORDER BY {COS} DESC, id LIMIT 10")
STOPPED = Analysis(False, False, frozenset({"the", "and"}))
STOPPED_BM = BM.replace("lambda x: x <> '')", "lambda x: x NOT IN ('', 'the', 'and'))")
add("V3_stop_words", lambda s, d: retrieval.bm25_indexed(retrieval.build_keyword_index(docs(s, d).select(F.col("doc_id").alias("id"), "text"), STOPPED), QUESTION, 20).selectExpr("id", r6("score")), f"WITH {STOPPED_BM} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
add("V3b_indexed_bm25", lambda s, d: retrieval.bm25_indexed(retrieval.build_keyword_index(docs(s, d).select(F.col("doc_id").alias("id"), "text")), QUESTION, 20).selectExpr("id", r6("score")), f"WITH {BM} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20")


def recall_tables(s, d):
    v = frame(s, d, "vectors")
    label = F.col("label") <= 4
    points = v.select(F.concat(F.lit("mem_"), F.when(label, F.col("id")).otherwise(F.col("id") - 1).cast("string"), F.when(label, "").otherwise("_c1")).alias("id"), "vector", F.when(label, "memory").otherwise("memory_chunk").alias("level"))
    memories = v.select(F.concat(F.lit("mem_"), F.col("id").cast("string")).alias("id"), F.when(F.col("label") == 2, "1").alias("deleted_at"), F.when(F.col("label") < 8, "a").otherwise("b").alias("project"))
    return points, memories


RECALL = f"""near AS (SELECT CASE WHEN label <= 4 THEN id ELSE id - 1 END AS id, label <= 4 AS intro, score FROM (SELECT id, label, {COS} AS score FROM vectors ORDER BY score DESC, CASE WHEN label <= 4 THEN 'mem_' || id ELSE 'mem_' || (id - 1) || '_c1' END LIMIT 80)),
 best AS (SELECT id, max(score) FILTER (WHERE intro) AS i, max(score) FILTER (WHERE NOT intro) AS c FROM near GROUP BY 1)"""
add("V8_A8_J2_recall", lambda s, d: retrieval.recall(*recall_tables(s, d), first_vector(s, d), 10, "a").select("id", F.round("score", 6).alias("score")),
    f", {RECALL} SELECT 'mem_' || b.id AS id, round(coalesce((i + c) / 2, i, c), 6) AS score FROM best b JOIN vectors v ON b.id = v.id WHERE v.label <> 2 AND v.label < 8 ORDER BY coalesce((i + c) / 2, i, c) DESC, 'mem_' || b.id LIMIT 10", "vectors")
_oracles["V8_A8_J2_recall"] = _oracles["V8_A8_J2_recall"].replace(") , near", "), near", 1)


TIERS = {"local": (0, 1, 2), "group": (2, 3, 4, 5), "global": (5, 6, 7, 8, 9)}


add("V8_recall_filtered_before", lambda s, d: retrieval.recall(*recall_tables(s, d), first_vector(s, d), 10, "a", before=True).select("id", F.round("score", 6).alias("score")),
    f""", near AS (SELECT CASE WHEN label <= 4 THEN id ELSE id - 1 END AS id, label <= 4 AS intro, score FROM (SELECT v.id, v.label, {COS.replace('vector::', 'v.vector::', 1)} AS score FROM vectors v JOIN vectors m ON m.id = CASE WHEN v.label <= 4 THEN v.id ELSE v.id - 1 END AND m.label <> 2 AND m.label < 8
      ORDER BY score DESC, CASE WHEN v.label <= 4 THEN 'mem_' || v.id ELSE 'mem_' || (v.id - 1) || '_c1' END LIMIT 80)),
    best AS (SELECT id, max(score) FILTER (WHERE intro) AS i, max(score) FILTER (WHERE NOT intro) AS c FROM near GROUP BY 1)
    SELECT 'mem_' || id AS id, round(coalesce((i + c) / 2, i, c), 6) AS score FROM best ORDER BY coalesce((i + c) / 2, i, c) DESC, 'mem_' || id LIMIT 10""", "vectors")


def tiers(s, d):
    q, v = first_vector(s, d), frame(s, d, "vectors")
    text = docs(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return {k: retrieval.knn(v, q, 8, where=F.col("label").isin(*labels)).join(text, "id", "left").select("id", "score", "content") for k, labels in TIERS.items()}


add("V5b_V9_fused_tiers", lambda s, d: retrieval.rrf(list(tiers(s, d).values()), 10).select("id", F.round("score", 6).alias("score"), "list"),
    f"""SELECT id, round(sum(1.0 / (60 + r)), 6) AS score, min(k)::INT AS list FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {COS} DESC, id) AS r FROM vectors, (SELECT unnest([0, 1, 2]) AS k)
    WHERE (k = 0 AND label <= 2) OR (k = 1 AND label BETWEEN 2 AND 5) OR (k = 2 AND label >= 5)) WHERE r <= 8 GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10""", "vectors")
SCOPED = """SELECT f.id, round(f.score, 6) AS score, {scope} AS scope, CASE WHEN NOT o THEN 'kept' WHEN sum(o::INT) OVER (ORDER BY f.score DESC, f.id) <= 3 THEN 'shortened' ELSE 'dropped' END AS outcome
    FROM (SELECT f.*, coalesce(strlen(d.text) // 4, 0) > greatest(2500 // count(*) OVER (), 128) AS o FROM (SELECT id, sum(1.0 / (60 + r)) AS score, min(k) AS k FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {cos} DESC, id) AS r FROM vectors, (SELECT unnest([{ks}]) AS k)
    WHERE (k = 0 AND label <= 2) OR (k = 1 AND label BETWEEN 2 AND 5) OR (k = 2 AND label >= 5)) WHERE r <= 8 GROUP BY id ORDER BY score DESC, id LIMIT 12) f LEFT JOIN documents d ON d.doc_id = f.id) f"""
for _scope, _group, _ks in (("all", "core", "0, 1, 2"), ("whatever", "", "0, 2"), ("global", "core", "2")):
    add(f"V10_recall_{_scope}", lambda s, d, scope=_scope, group=_group: compose.recalled_scopes(tiers(s, d), scope, group, 12, 2500).select("id", F.round("score", 6).alias("score"), "scope", "outcome"),
        SCOPED.format(cos=COS, ks=_ks, scope="CASE k WHEN 0 THEN 'local' WHEN 1 THEN 'group' ELSE 'global' END"), "vectors")
WANTED = ("th", "an", "ing", "que", "der", "los")


def keyworded(text):
    return models.keyword_embedding(text, WANTED)


SENTENCES = r"""SELECT doc_id AS id, text, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)) AS t, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents)"""
V11 = f""", s AS (SELECT id, text, t, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, [{', '.join(f"contains(lower(t), '{w}')::INT::DOUBLE" for w in WANTED)}] AS v FROM ({SENTENCES}) WHERE t <> ''),
 r AS (SELECT s.id, s.text, s.pos, s.t, len(s.t) // 4 AS n, row_number() OVER (PARTITION BY s.id ORDER BY round(CASE WHEN list_sum(s.v) > 0 AND list_sum(a.v) > 0 THEN list_inner_product(s.v, a.v) / sqrt(list_sum(s.v) * list_sum(a.v)) ELSE 0 END, 9) DESC, s.pos) AS k FROM s JOIN s a ON s.id = a.id AND a.pos = 0),
 f AS (SELECT id, k, n AS used, true AS taken FROM r WHERE k = 1 UNION ALL SELECT r.id, r.k, f.used + CASE WHEN f.used < 60 AND f.used + r.n <= 60 THEN r.n ELSE 0 END, f.used < 60 AND f.used + r.n <= 60 FROM f JOIN r ON r.id = f.id AND r.k = f.k + 1),
 p AS (SELECT r.id, string_agg(r.t, ' ' ORDER BY r.pos) AS picked FROM r JOIN f ON f.id = r.id AND f.k = r.k AND f.taken GROUP BY r.id)
 SELECT d.doc_id AS id, CASE WHEN (SELECT count(*) FROM s WHERE s.id = d.doc_id) <= 1 OR len(d.text) // 4 <= 60 THEN trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) ELSE p.picked END AS summary FROM documents d LEFT JOIN p ON p.id = d.doc_id"""


def summarized(s, d):
    return budget.extractive(budget.anchored_sentences(docs(s, d).select(F.col("doc_id").alias("id"), "text"), keyworded, digits=9), 60)


add("V11_extractive", summarized, "WITH RECURSIVE" + V11[1:])

# --- graphs
BFS = """, bfs AS (SELECT 'down' AS direction, 'p5' AS symbol, 0 AS depth UNION SELECT 'up', 'p5', 0 UNION
 SELECT b.direction, CASE b.direction WHEN 'down' THEN e.target ELSE e.source END, b.depth + 1 FROM bfs b JOIN (SELECT DISTINCT source, target FROM edges) e ON (b.direction = 'down' AND e.source = b.symbol) OR (b.direction = 'up' AND e.target = b.symbol) WHERE b.depth < 2)
 SELECT direction, symbol, min(depth)::INT AS depth FROM bfs GROUP BY 1, 2 HAVING symbol <> 'p5'"""
add("G3_impact", lambda s, d: graph.impact(frame(s, d, "edges"), "p5", 3), BFS.replace("depth < 2", "depth < 3"), "edges")
add("G5_graph", lambda s, d: graph.assembled_nodes(frame(s, d, "edges"), hide_external=True).select("id", "label", "file"), "SELECT source AS id, source AS label, min(file) AS file FROM edges GROUP BY 1", "edges")
add("G5_edge_numbers", lambda s, d: graph.numbered_edges(graph.export(frame(s, d, "edges"), file="s3")).select("edge_id", "source", "target", "line"), "SELECT 'e' || (row_number() OVER (ORDER BY source, target, kind, file, line) - 1) AS edge_id, source, target, line FROM edges WHERE file = 's3'", "edges")
add("G6_first_edges", lambda s, d: graph.first_edges(frame(s, d, "edges")), "SELECT file, source, target, kind, min(line) AS line FROM edges GROUP BY 1, 2, 3, 4", "edges")

# --- notes
events = lambda s, d: docs(s, d).select(F.col("source").alias("project"), F.when(F.col("lang") == "de", F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).otherwise("").alias("topic"), F.col("text").alias("content"), F.col("doc_id").alias("at"))
REMEMBER = f"""WITH e AS (SELECT source AS project, CASE WHEN lang = 'de' THEN 't' || (doc_id % 5) ELSE '' END AS topic, sha256({NORM}) AS hash, doc_id AS pos FROM documents),
 k AS (SELECT *, CASE WHEN topic <> '' THEN 't:' || topic ELSE 'c:' || hash END AS key FROM e), l AS (SELECT *, lag(hash) OVER (PARTITION BY project, key ORDER BY pos, hash) AS b FROM k)
 SELECT project, key, 'mem_' || left(sha256(project || ':' || arg_min(hash, pos)), 24) AS id, min(pos) AS created_at, max(pos) AS updated_at, count(*) FILTER (WHERE b IS NOT NULL AND b <> hash) AS revisions, count(*) FILTER (WHERE b = hash) AS duplicates FROM l GROUP BY 1, 2"""
add("M1_remember", lambda s, d: memory.remembered(events(s, d)).drop("content"), REMEMBER)
add("M4_soft_delete", lambda s, d: memory.soft_deleted(frame(s, d, "memories"), frame(s, d, "memories").where("project = 'proj1'").select("id"), "9").groupBy("project").agg(F.count("deleted_at").alias("n")),
    "SELECT project, count(CASE WHEN project = 'proj1' THEN '9' ELSE deleted_at END) AS n FROM memories GROUP BY 1", "memories")
add("M5_forget", lambda s, d: memory.forgotten(frame(s, d, "memories"), frame(s, d, "memories").where("memory_type = 'system'").select("id")).select("id"), "SELECT id FROM memories WHERE memory_type <> 'system'", "memories")
FILES = f"SELECT DISTINCT id AS memory_id, trim(unnest(string_split(files, ','))) AS file FROM memories WHERE {LIVE}"
add("M6_file_refs", lambda s, d: memory.file_refs(frame(s, d, "memories")).select("memory_id", "file"), FILES, "memories")
stated = lambda s, d: frame(s, d, "memories").withColumn("files", F.when(F.col("project") == "proj2", "").when(F.col("project") == "proj3", "gone/x.py").otherwise(F.col("files"))).withColumn("content", F.when(F.col("memory_type") == "user", F.concat("content", F.lit(" see src3/f3.py. Card1.charge1"))).otherwise(F.concat("content", F.lit(" Card1.charge1"))))
BACKFILL = f"""m AS (SELECT id, CASE project WHEN 'proj2' THEN '' WHEN 'proj3' THEN 'gone/x.py' ELSE files END AS files, memory_type FROM memories WHERE {LIVE}),
 live AS (SELECT DISTINCT file FROM points WHERE NOT is_deletion),
 w AS (SELECT id, trim(unnest(string_split(files, ','))) AS file FROM m WHERE files <> '' UNION SELECT id, 'src3/f3.py' FROM m WHERE files = '' AND memory_type = 'user'),
 hit AS (SELECT w.id, w.file FROM w JOIN live ON w.file = live.file),
 sym AS (SELECT DISTINCT hit.id, p.symbol, p.file FROM hit JOIN points p ON p.file = hit.file WHERE NOT p.is_deletion AND suffix(p.symbol, '::Card1.charge1')),
 t AS (SELECT m.id, m.files = '' AS none, (SELECT count(*) FROM hit WHERE hit.id = m.id) AS n, (SELECT count(*) FROM sym WHERE sym.id = m.id) AS k FROM m)"""
add("M8_A11_backfill_report", lambda s, d: memory.backfill_report(memory.backfilled(stated(s, d), frame(s, d, "points"), from_text=True)[0]),
    f", {BACKFILL} SELECT count(*) AS examined, count(*) FILTER (WHERE n > 0) AS matched, count(*) FILTER (WHERE k > 0) AS linked, sum(n + k)::BIGINT AS rows, count(*) FILTER (WHERE n = 0 AND none) AS without_files, count(*) FILTER (WHERE n > 0 AND none) AS from_text, count(*) FILTER (WHERE n = 0 AND NOT none) AS not_in_repo FROM t", "memories", "points")
add("M8_backfill_links", lambda s, d: memory.backfilled(stated(s, d), frame(s, d, "points"), from_text=True)[1].select("memory_id", "symbol", "file", "source"),
    f", {BACKFILL} SELECT id AS memory_id, '' AS symbol, file, 'files-field' AS source FROM hit UNION ALL SELECT id, symbol, file, 'content-mention' FROM sym", "memories", "points")
add("M6_rebuilt_links", lambda s, d: memory.rebuilt_links(memory.file_refs(frame(s, d, "memories").withColumn("files", F.lit("old.py"))), stated(s, d).where("project = 'proj1'"), frame(s, d, "points")).select("memory_id", "symbol", "file", "source"),
    f""", m AS (SELECT DISTINCT id, trim(unnest(string_split(files, ','))) AS file FROM memories WHERE {LIVE} AND project = 'proj1')
    SELECT id AS memory_id, '' AS symbol, 'old.py' AS file, 'files-field' AS source FROM memories WHERE {LIVE} AND project <> 'proj1' UNION ALL SELECT id, '', file, 'files-field' FROM m
    UNION ALL SELECT DISTINCT m.id, p.symbol, p.file, 'content-mention' FROM m JOIN points p ON p.file = m.file WHERE NOT p.is_deletion AND suffix(p.symbol, '::Card1.charge1')""", "memories", "points")
add("A11_import_report", lambda s, d: memory.import_report(memory.import_outcomes(hashes(s, d).where("lang = 'fr'").select("project", "hash", "topic"), hashes(s, d).select("project", "hash", "topic", "pos"))),
    "SELECT count(*) AS seen, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'present') AS present, count(*) FILTER (WHERE outcome = 'topic_collision') AS topic_collision FROM (" + IMPORT + ")")
refs = lambda s, d: memory.file_refs(frame(s, d, "memories")).select("memory_id", F.col("file").alias("symbol"), "file", F.explode(F.array(F.lit("files-field"), F.lit("content-mention"))).alias("source"))
add("A7_link_sources", lambda s, d: memory.link_sources(refs(s, d), "file"), f"SELECT memory_id, file, 'content-mention,files-field' AS sources FROM ({FILES})", "memories")
add("M9_notes_of_file", lambda s, d: memory.notes_of_file(memory.file_refs(frame(s, d, "memories")), frame(s, d, "memories"), "f7.py", 10, s.createDataFrame([("src7/f7.py",), ("src1/f1.py",), ("a/f3.py",)], "file string")).select("id", "sources"),
    f"SELECT id, 'files-field' AS sources FROM memories WHERE {LIVE} AND list_contains(list_transform(string_split(files, ','), lambda x: trim(x)), 'src7/f7.py') ORDER BY updated_at DESC, id LIMIT 10", "memories")
add("M9_linked_or_inferred", lambda s, d: memory.linked_or_inferred(refs(s, d), frame(s, d, "memories"), "none::nding", 10).select("id", "sources"), f"SELECT id, 'inference' AS sources FROM memories WHERE {LIVE} AND (contains(content, 'nding') OR contains(files, 'nding')) ORDER BY updated_at DESC, id LIMIT 10", "memories")
add("M10_L8_memory_refs", lambda s, d: memory.refs_of(refs(s, d), "mem_3x1").select("source", "file"), f"SELECT s.source, f.file FROM ({FILES}) f, (SELECT 'files-field' AS source UNION ALL SELECT 'content-mention') s WHERE memory_id = 'mem_3x1'", "memories")
add("M12_move", lambda s, d: memory.moved(frame(s, d, "memories"), frame(s, d, "memories").where("memory_type = 'system'").select("id"), "dest").groupBy("project").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN memory_type = 'system' THEN 'dest' ELSE project END AS project, count(DISTINCT CASE WHEN memory_type = 'system' THEN {NORM.replace('text', 'content')} ELSE id END) AS n FROM memories GROUP BY 1", "memories")

# --- state
add("M13_branch_copy", lambda s, d: state.copied_points(frame(s, d, "points"), frame(s, d, "points").where("branch = 'fr'").select("file", F.lit("fr").alias("from_branch")).distinct(), "copy").select("id", "branch", "file"), "SELECT id || '@copy' AS id, 'copy' AS branch, file FROM points WHERE branch = 'fr'", "points")
BRANCH_FILES = lambda s, d: frame(s, d, "points").where("branch = 'fr'").select("repo", "file", F.lit("fr").alias("from_branch")).distinct()
route_points = lambda s, d: frame(s, d, "states").select("repo", "branch", "file", F.concat("file", F.lit("#"), "hash").alias("path"))


def branch_copied(s, d, part):
    rows = route_points(s, d).distinct()
    return state.copied_branch(frame(s, d, "points").drop("text"), rows, rows, BRANCH_FILES(s, d), "es")[part]


add("M13_copied_points", lambda s, d: branch_copied(s, d, 0).select("id", "branch"), "SELECT id, branch FROM points UNION ALL SELECT id || '@es', 'es' FROM points WHERE branch = 'fr'", "points")
add("M13_copied_routes", lambda s, d: branch_copied(s, d, 1).select("repo", "branch", "file", "path"),
    """SELECT DISTINCT repo, branch, file, file || '#' || hash AS path FROM states s WHERE NOT (branch = 'es' AND EXISTS (SELECT 1 FROM points p WHERE p.branch = 'fr' AND p.repo = s.repo AND p.file = s.file))
    UNION ALL SELECT DISTINCT repo, 'es', file, file || '#' || hash FROM states s WHERE branch = 'fr' AND EXISTS (SELECT 1 FROM points p WHERE p.branch = 'fr' AND p.repo = s.repo AND p.file = s.file)""", "points", "states")
add("M13_copied_files", lambda s, d: branch_copied(s, d, 3), "SELECT file, min(language) AS language, count(DISTINCT nullif(symbol, '')) AS symbols, count(*) AS chunks FROM points WHERE branch = 'fr' GROUP BY 1", "points")


def dropped(s, d):
    kept = state.dropped_branch({"points": frame(s, d, "points"), "states": frame(s, d, "states"), "routes": frame(s, d, "routes")}, "src0", "en")
    rows = [t.select(F.lit(n).alias("name"), "repo", "branch") for n, t in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("name", "repo", "branch").agg(F.count("*").alias("n"))


add("M14_drop_branch", dropped, "SELECT name, repo, branch, count(*) AS n FROM (SELECT 'points' AS name, repo, branch FROM points UNION ALL SELECT 'states', repo, branch FROM states UNION ALL SELECT 'routes', repo, branch FROM routes) WHERE NOT (repo = 'src0' AND branch = 'en') GROUP BY ALL", "points", "states", "routes")
add("M15_replace_routes", lambda s, d: state.replaced_routes(frame(s, d, "routes").where("line % 3 <> 1"), frame(s, d, "routes").where("line % 3 <> 0 AND file < 'web5'")).select("framework", "http_method", "path", "line"),
    """SELECT framework, http_method, path, line FROM (SELECT *, row_number() OVER (PARTITION BY framework, http_method, path, repo, branch ORDER BY new, file, line) AS k FROM
    (SELECT 0 AS new, * FROM routes WHERE line % 3 <> 1 AND file NOT IN (SELECT file FROM routes WHERE line % 3 <> 0 AND file < 'web5') UNION ALL SELECT 1, * FROM routes WHERE line % 3 <> 0 AND file < 'web5')) WHERE k = 1""", "routes")
def rebuilt(s, d):
    """A table after all its rows were written anew."""
    path = T.written(frame(s, d, "states"), "before").inputFiles()[0].rsplit("/", 1)[0]
    return T.rewritten(s, path, 100).groupBy("repo", "branch").agg(F.count("*").alias("n"), F.sum("symbols").alias("symbols"))


add("M19_rebuilt", rebuilt, "SELECT repo, branch, count(*) AS n, sum(symbols)::BIGINT AS symbols FROM states GROUP BY 1, 2", "states")
add("M17_X1_cascade", lambda s, d: state.without_files(frame(s, d, "states"), frame(s, d, "states").where("hash = '3'")).groupBy("repo").agg(F.count("*").alias("n")),
    "SELECT repo, count(*) AS n FROM states s WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.hash = '3' AND x.repo = s.repo AND x.branch = s.branch AND x.file = s.file) GROUP BY 1", "states")
add("M18_X10_register", lambda s, d: state.registered(frame(s, d, "projects"), frame(s, d, "projects").where("NOT active").select(F.concat("name", F.lit("2")).alias("name"), "path", F.lit("").alias("last_commit"), F.lit(False).alias("active"))), "SELECT CASE WHEN active THEN name ELSE name || '2' END AS name, path, last_commit, true AS active FROM projects", "projects")
SOME_NATIONS = "SELECT n_name FROM nation WHERE n_nationkey % 5 = 0"
some_nations = lambda s, d: [r["n_name"] for r in T.table(s, d, "nation").where("n_nationkey % 5 = 0").orderBy("n_nationkey").collect()]
add("M18_refresh", lambda s, d: state.refreshed(frame(s, d, "projects"), some_nations(s, d), frame(s, d, "projects").select("path", F.lit("new").alias("last_commit"))), f"SELECT name, path, CASE WHEN name IN ({SOME_NATIONS}) THEN 'new' ELSE last_commit END AS last_commit, active OR name IN ({SOME_NATIONS}) AS active FROM projects", "projects")
add("M18_deactivate_remove", lambda s, d: state.removed(state.deactivated(frame(s, d, "projects"), some_nations(s, d)[1]), some_nations(s, d)[0]), "SELECT name, path, last_commit, active AND name <> (SELECT n_name FROM nation WHERE n_nationkey = 5) AS active FROM projects WHERE name <> (SELECT n_name FROM nation WHERE n_nationkey = 0)", "projects")
add("M18_index_stats", lambda s, d: state.with_index_stats(frame(s, d, "projects"), frame(s, d, "projects").where("active").select("path", F.lit("head").alias("last_commit")).unionByName(s.createDataFrame([("elsewhere", "x")], "path string, last_commit string"))), "SELECT name, path, CASE WHEN active THEN 'head' ELSE last_commit END AS last_commit, active FROM projects", "projects")
add("M17_X2_saved_states", lambda s, d: state.indexed_files(state.saved(frame(s, d, "states").select("repo", "branch", "file", "hash").distinct(), frame(s, d, "states").where("hash = '3'").select("repo", "branch", "file", F.lit("9").alias("hash")).distinct().unionByName(s.createDataFrame([("src0", "en", "new.py", "1")], "repo string, branch string, file string, hash string")), "repo", "branch", "file"), "src0", "en"),
    "SELECT DISTINCT file FROM states WHERE repo = 'src0' AND branch = 'en' UNION ALL SELECT 'new.py'", "states")
own_files = lambda s, d: frame(s, d, "states").groupBy("repo", "branch", "file").agg(F.max("hash").alias("hash")).withColumn("model", F.lit("m"))


def incremental(s, d):
    """An index run over every given path of a branch: some unchanged, some new, some gone, some held by another branch."""
    states = own_files(s, d)
    mine = states.where("repo = 'src1' AND branch = 'en'")
    now = mine.where("hash <> '6'").select("file", F.when(F.col("hash") == "1", "x").otherwise(F.col("hash")).alias("hash")).unionByName(states.where("repo = 'src1' AND branch = 'fr'").join(mine, "file", "left_anti").select("file", "hash"))
    paths = mine.select("file").unionByName(now.select("file")).distinct()
    return watch.incremental(states, paths, now, "src1", "en", "m")


_STATES = "s AS (SELECT repo, branch, file, max(hash) AS hash FROM states GROUP BY ALL), e AS (SELECT * FROM s WHERE repo = 'src1' AND branch = 'en'), n AS (SELECT file, hash FROM s WHERE repo = 'src1' AND branch = 'fr' AND file NOT IN (SELECT file FROM e))"
add("W2_incremental_outcomes", lambda s, d: incremental(s, d)[1].select("file", "outcome"),
    f", {_STATES} SELECT file, CASE hash WHEN '6' THEN 'deleted' WHEN '1' THEN 'indexed' ELSE 'skipped' END AS outcome FROM e UNION ALL SELECT file, 'copied' FROM n", "states")
add("W2_incremental_states", lambda s, d: incremental(s, d)[0].select("repo", "branch", "file", "hash"),
    f", {_STATES} SELECT repo, branch, file, hash FROM s WHERE NOT (repo = 'src1' AND branch = 'en' AND hash IN ('1', '6')) UNION ALL SELECT repo, branch, file, 'x' FROM e WHERE hash = '1' UNION ALL SELECT 'src1', 'en', file, hash FROM n", "states")
add("A11_run_report", lambda s, d: state.run_report(incremental(s, d)[1]),
    f", {_STATES} SELECT count(*) FILTER (WHERE hash = '1') AS files_indexed, count(*) FILTER (WHERE hash NOT IN ('1', '6')) AS files_skipped, count(*) FILTER (WHERE hash = '6') AS files_deleted, 0::BIGINT AS files_pruned, 0::BIGINT AS files_renamed, (SELECT count(*) FROM n) AS files_copied FROM e", "states")
add("X9_reindex_targets", lambda s, d: state.reindex_targets(frame(s, d, "projects"), None, True, "").select("name"), "SELECT name FROM projects WHERE active", "projects")

# --- budgets
add("R2_fit_memories", lambda s, d: budget.fitted(docs(s, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"), (F.col("doc_id") % 97).alias("list")), 8000, "list").select("id", "list", "outcome"),
    """WITH m AS (SELECT doc_id AS id, doc_id % 97 AS list, strlen(text) // 4 > greatest(8000 // count(*) OVER (PARTITION BY doc_id % 97), 128) AS o FROM documents)
    SELECT id, list, CASE WHEN NOT o THEN 'kept' WHEN sum(o::INT) OVER (PARTITION BY list ORDER BY id) <= 3 THEN 'shortened' ELSE 'dropped' END AS outcome FROM m""")
add("R1_stop_at_misfit", lambda s, d: budget.packed(docs(s, d).select(F.col("source").alias("grp"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("bytes")), 16_384, stop=True).where("taken").select("grp", "id"),
    "SELECT grp, id FROM (SELECT source AS grp, doc_id AS id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b <= 16384")
add("R1_skip_misfits", lambda s, d: budget.packed(frame(s, d, "memories").select(F.split("id", "x")[0].alias("grp"), F.split("id", "x")[1].cast("int").alias("rank"), "id", F.octet_length("content").cast("long").alias("bytes")), 700).select("id", "taken"),
    """, m AS (SELECT id, split_part(id, 'x', 1) AS grp, strlen(content) AS n, row_number() OVER (PARTITION BY split_part(id, 'x', 1) ORDER BY split_part(id, 'x', 2)::INT, id) AS k FROM memories),
    f AS (SELECT grp, k, id, CASE WHEN n <= 700 THEN n ELSE 0 END AS used, n <= 700 AS taken FROM m WHERE k = 1 UNION ALL
    SELECT m.grp, m.k, m.id, f.used + CASE WHEN f.used + m.n <= 700 THEN m.n ELSE 0 END, f.used + m.n <= 700 FROM f JOIN m ON m.grp = f.grp AND m.k = f.k + 1) SELECT id, taken FROM f""", "memories")


def brief_tables(s, d):
    """Notes of a recall, code found by vectors, and the notes that are linked to files."""
    q, notes = first_vector(s, d), frame(s, d, "memories")
    near = retrieval.knn(frame(s, d, "vectors"), q, 60).select("id", "score")
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # sixty rows
    code = frame(s, d, "points").withColumn("n", F.substring("id", 2, 20).cast("long"))
    hits = ranked.join(code.select(F.col("n").alias("id"), "file", F.col("start_line").alias("line"), F.substring("text", 1, 900).alias("text")), "id").where("rank > 30").select("rank", "file", "line", "text")
    recalled = ranked.where("rank <= 5").join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id").select("rank", F.concat(F.lit("t"), F.col("rank").cast("string")).alias("title"), F.substring("text", 1, 700).alias("content"), F.concat(F.lit("src1/f"), (F.col("id") % 40).cast("string"), F.lit(".py, x")).alias("files"))
    linked = memory.file_refs(notes).select("memory_id", "file").join(notes.select(F.col("id").alias("memory_id"), "topic", "content", "updated_at"), "memory_id")
    noted = linked.select("file", F.col("memory_id").alias("id"), F.col("topic").alias("title"), "content", F.lit("files-field").alias("sources"), "updated_at")
    return recalled, hits, noted


BRIEF = f""", near AS (SELECT id, row_number() OVER (ORDER BY {COS} DESC, id) AS rank FROM vectors ORDER BY {COS} DESC, id LIMIT 60),
 rec AS (SELECT rank, '[note] t' || rank || chr(10) || left(text, 700) || chr(10) || chr(10) AS t, 't' || rank AS nm, 'src1/f' || (id % 40) || '.py' AS file FROM near JOIN documents ON doc_id = id WHERE rank <= 5),
 hit AS (SELECT rank, file, file || ':' || start_line AS nm, '// ' || file || ':' || start_line || chr(10) || left(text, 900) || chr(10) || chr(10) AS t FROM near n JOIN points p ON p.id = 'd' || n.id WHERE rank > 30 AND file NOT IN (SELECT file FROM rec)),
 one AS (SELECT row_number() OVER (ORDER BY sec, rank, file, t) AS k, * FROM (SELECT 1 AS sec, rank, t, '' AS file, nm FROM rec UNION ALL SELECT 2, rank, t, file, nm FROM hit)),
 a AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, 0 AS dropped, 0 AS head, false AS ended, '' AS txt, []::VARCHAR[] AS seen, []::VARCHAR[] AS names UNION ALL
  SELECT k, used + CASE WHEN fits THEN strlen(b) ELSE 0 END, dropped + CASE WHEN fits OR (sec = 2 AND ended) THEN 0 ELSE 1 END, CASE WHEN fits THEN sec ELSE head END, ended OR (sec = 2 AND NOT fits), txt || CASE WHEN fits THEN b ELSE '' END,
   CASE WHEN sec = 1 OR ended OR list_contains(seen, file) THEN seen ELSE list_append(seen, file) END, CASE WHEN fits OR (sec = 2 AND ended) THEN names ELSE list_append(names, nm) END
  FROM (SELECT o.k, o.sec, o.file, o.nm, a.used, a.dropped, a.head, a.ended, a.txt, a.seen, a.names, CASE WHEN a.head = o.sec THEN '' WHEN o.sec = 1 THEN '## Known already' || chr(10) || chr(10) ELSE '## Code' || chr(10) || chr(10) END || o.t AS b,
   NOT (o.sec = 2 AND a.ended) AND a.used + strlen(CASE WHEN a.head = o.sec THEN '' WHEN o.sec = 1 THEN '## Known already' || chr(10) || chr(10) ELSE '## Code' || chr(10) || chr(10) END || o.t) <= 10000 AS fits FROM a JOIN one o ON o.k = a.k + 1)),
 mid AS (SELECT * FROM a ORDER BY k DESC LIMIT 1),
 look AS (SELECT unnest(seen[1:5]) AS file, unnest(generate_series(1, least(5, len(seen)))) AS pos FROM mid),
 ref AS (SELECT DISTINCT id, topic, content, updated_at, trim(unnest(string_split(files, ','))) AS file FROM memories WHERE {LIVE}),
 clo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, place) AS first FROM (SELECT r.*, l.pos, row_number() OVER (PARTITION BY r.file ORDER BY updated_at DESC, r.id) AS place FROM ref r JOIN look l ON r.file = l.file) WHERE place <= 5) WHERE first = 1),
 two AS (SELECT row_number() OVER (ORDER BY pos, place) AS k, topic AS nm, '[note · files-field · about ' || file || '] ' || topic || chr(10) || content || chr(10) || chr(10) AS t FROM clo),
 z AS (SELECT 0::BIGINT AS k, used, dropped, false AS head, txt, names FROM mid UNION ALL
  SELECT k, used + CASE WHEN fits THEN strlen(b) ELSE 0 END, dropped + CASE WHEN fits THEN 0 ELSE 1 END, head OR fits, txt || CASE WHEN fits THEN b ELSE '' END, CASE WHEN fits THEN names ELSE list_append(names, nm) END FROM
  (SELECT o.k, o.nm, z.used, z.dropped, z.head, z.txt, z.names, CASE WHEN z.head THEN '' ELSE '## Recorded about this code' || chr(10) || chr(10) END || o.t AS b, z.used + strlen(CASE WHEN z.head THEN '' ELSE '## Recorded about this code' || chr(10) || chr(10) END || o.t) <= 10000 AS fits FROM z JOIN two o ON o.k = z.k + 1))
 SELECT txt || CASE WHEN dropped > 0 THEN chr(10) || dropped || ' further item(s) did not fit in 2500 tokens.' || chr(10) ELSE '' END AS text, used, dropped, array_to_string(names, '|') AS dropped_names FROM z ORDER BY k DESC LIMIT 1"""
add("R1_brief", lambda s, d: compose.brief(*brief_tables(s, d), 2500).withColumn("dropped_names", F.array_join("dropped_names", "|")), BRIEF, "points", "vectors", "memories")
add("R4_labels", lambda s, d: frame(s, d, "memories").select("id", budget.label(F.col("topic"), F.col("id")).alias("label")), "SELECT id, CASE WHEN topic <> '' THEN topic ELSE id END AS label FROM memories", "memories")

# --- streaming semantics, in batch
add("W1_debounce", lambda s, d: watch.debounced(frame(s, d, "saves"), "6 hours", key_col="user_id").select("user_id", "start", "events"),
    "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, path) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, path) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM saves)) GROUP BY user_id, g", "saves")
