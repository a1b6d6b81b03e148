"""The engine's domain tables as projections of the given ones, in SQL that Spark and the reference database both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvina.sources.tables import table

SQL = {
    "points": """SELECT 'd' || cast(doc_id AS string) AS id, source || '/f' || cast(doc_id % 40 AS string) || '.py' AS file, source AS repo, lang AS branch, CASE WHEN n_chars > 2000 THEN 'file' ELSE 'function' END AS level,
 lang AS language, 'note' AS memory_type, CASE WHEN n_chars < 400 THEN '' ELSE source || '::Card' || cast(doc_id % 7 AS string) || '.charge' || cast(doc_id % 30 AS string) END AS symbol, doc_id % 90 AS start_line, text, n_chars < 60 AS is_deletion FROM documents""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings WHERE embedding IS NOT NULL",
    "memories": """SELECT 'mem_' || cast(conv_id AS string) || 'x' || cast(turn AS string) AS id, CASE WHEN role = 'system' THEN '@global' WHEN conv_id % 9 = 0 THEN '@group:core' ELSE 'proj' || cast(conv_id % 5 AS string) END AS project,
 role AS memory_type, CASE WHEN turn = 0 THEN 't' || cast(conv_id % 50 AS string) ELSE '' END AS topic, text AS content, 'src' || cast(conv_id % 20 AS string) || '/f' || cast(conv_id % 40 AS string) || '.py, src1/f1.py' AS files, 'r' AS repo, 'main' AS branch,
 cast(1000000 + conv_id AS string) AS created_at, cast(1000000 + conv_id * 10 + turn AS string) AS updated_at, CASE WHEN length(text) < 60 THEN '1' END AS deleted_at FROM conversations""",
    "edges": """SELECT DISTINCT 'p' || cast(a AS string) AS source, 'p' || cast(b AS string) AS target, 'calls' AS kind, 's' || cast(f AS string) AS file, n AS line FROM
 (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b, l_suppkey AS f, l_linenumber AS n FROM lineitem) x WHERE b IS NOT NULL""",
    "routes": """SELECT CASE WHEN page_id % 3 = 0 THEN 'flask' ELSE 'spring' END AS framework, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'post' END AS http_method, regexp_replace(url, '^https?://[^/]*', '') AS path,
 'Shop.page' || cast(page_id % 40 AS string) AS handler_symbol, 'page' || cast(page_id % 40 AS string) AS handler_method, 'r' AS repo, 'main' AS branch, 'web' || cast(page_id % 12 AS string) || '.py' AS file, page_id AS line FROM pages""",
    "states": """SELECT source AS repo, lang AS branch, source || '/f' || cast(doc_id % 200 AS string) || '.py' AS file, cast(length(text) % 7 AS string) AS hash, 'm' AS model, doc_id % 5 AS symbols, CASE WHEN n_chars > 100 THEN n_chars % 9 END AS chunks FROM documents""",
    "projects": """SELECT n_name AS name, 'r' || cast(n_regionkey AS string) || '/' || n_name AS path, 'c' || cast(n_nationkey % 4 AS string) AS last_commit, n_nationkey % 6 <> 0 AS active FROM nation""",
    "heads": "SELECT n_name AS name, 'c' || cast(n_regionkey % 4 AS string) AS head FROM nation",
    "saves": "SELECT ts, user_id, event_type || '.py' AS path FROM events",
}


#: Rows that a task of a shuffle gets, about, where it holds them all: for a window over keys, or to find distinct rows.
TASK_ROWS = 1_000_000


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a table. Where it parts rows by a key or drops repeated ones, tasks are as many as the rows ask for, whatever the session says."""
    import re

    names = set(re.findall(r"FROM\s+(documents|embeddings|conversations|lineitem|pages|nation|events)\b", SQL[name]))
    tables = {n: table(spark, sf_dir, n) for n in names}
    text = SQL[name]
    for n in names:
        text = re.sub(rf"FROM\s+{n}\b", f"FROM {{{n}}}", text)
    tasks = lambda: max(1, *(-(-t.count() // TASK_ROWS) for t in tables.values()))
    if key := re.search(r"PARTITION BY (\w+)", text):
        tables = {n: t.repartition(tasks(), key[1]) for n, t in tables.items()}
    distinct = text.startswith("SELECT DISTINCT ")
    rows = spark.sql(text.replace("SELECT DISTINCT ", "SELECT ", 1) if distinct else text, **tables)
    # Constants are no keys: the optimizer takes them out of those that rows are compared by, and would deal the rows again.
    keys = [c for c in rows.columns if c not in re.findall(r"'\w*' AS (\w+)", text)]
    return rows.repartition(tasks(), *keys).distinct() if distinct else rows


def oracle(body: str, *names: str) -> str:
    """A query over projections, for the reference database; its own WITH clause, or a further one after a comma, joins theirs."""
    body = body.strip()
    more = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ").removeprefix(",").strip()
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if more != body else " ") + more
