"""The queries over the ten operators, with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import bpe, chat, langid, line_dedup, minhash, packing, quality, token_counts, vector_graph, warc
from corvina.llm.common import table

CAPACITY, END_ID = 2048, 0


def tokenizer() -> str:
    """The path of the public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), CAPACITY, END_ID).withColumnRenamed("id", "doc_id")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")), keep=["page_id"])
    field = lambda k: F.col("headers")[k]
    return made.select(
        "page_id", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Block-Digest").alias("block_digest"), field("WARC-Refers-To-Payload-Digest").alias("source_digest"), field("Content-Length").cast("long").alias("content_length"), F.col("block").cast("string").alias("content"),
    )


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer()), tokenizer())
    return both.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer())


def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out(docs))
    return langid.predict(docs.withColumn("held_out", langid.held_out(docs)), model, ["doc_id", "held_out"])


def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "words_id", F.col("component").alias("component_id"), "kept")


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    back = chat.read(chat.format_conversations(rows.unionByName(more)))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "learned")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


QUERIES = {
    "op1_line_dedup": line_dedup_query,
    "op2_best_fit_packing": packing_query,
    "op3_warc_derivatives": warc_query,
    "op4_quality_rules": quality_query,
    "op5_bpe": bpe_query,
    "op6_token_counts": token_counts_query,
    "op7_embedding_near_dedup": vector_query,
    "op8_language_id": langid_query,
    "op9_minhash": minhash_query,
    "op10_chat_format": chat_query,
}

WORD = r"[^\x20\x09-\x0D]"

LINE_DEDUP_SQL = rf"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS i FROM doc),
word AS (SELECT * FROM line WHERE regexp_matches(line, '{WORD}')),
win AS (SELECT doc_id, i AS start, lead(i, 2) OVER w AS stop, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, start) AS k FROM win WHERE stop IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(start, stop)) AS i FROM later)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


QUALITY_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM doc)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(generate_series(0, 7)) AS k FROM dup) GROUP BY 1),
line AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}+')) AS n, len(regexp_extract_all(line, '[{quality.SEPARATORS}]')) + CASE WHEN contains(line, '«') THEN 0 ELSE len(line) - len(replace(line, '»', '')) END AS parts FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc)),
judged AS (
  SELECT doc_id, line, n,
    NOT regexp_matches(line, '{_quoted(quality.ENDING)}')
    OR (len(line) - len(replace(line, '!', '')) >= 3 AND len(line) - len(replace(line, '!', '')) > n)
    OR (parts >= 2 AND 4 * parts > n)
    OR (len(regexp_extract_all(line, '[#*$%&<>]')) >= 3 AND 5 * len(regexp_extract_all(line, '[#*$%&<>]')) > n)
    OR regexp_matches(line, '{_quoted(quality.BOILERPLATE)}') AS bad
  FROM line WHERE n > 0),
sums AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS kept_words FROM judged GROUP BY 1),
base AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(list_sum(list_transform(d.w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(s.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(s.kept_words, 0) AS kept_words
  FROM doc d LEFT JOIN rep r ON d.doc_id = r.doc_id LEFT JOIN sums s ON d.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND 100 * kept_words >= {quality.MIN_KEPT_PERCENT} * n_words AS kept
FROM base
"""

_ESCAPED = rf"regexp_replace(%s, '([<\[])(\\*)({chat.TAILS})', '\1\2\\\3', 'g')"

CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (SELECT *, {_ESCAPED % "text"} AS t, {_ESCAPED % "replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')"} AS r FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = '{chat.LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.LEARNED}'), '')) AS loss_sha256,
  sum({len(chat.START + chat.BREAK + chat.END)} + len(r) + len(t))::BIGINT AS formatted_chars
FROM made GROUP BY conv_id
"""

VECTOR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {vector_graph.THRESHOLD}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
class AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.u = v.vec_id) AS n_links, class.c AS component_id, class.c = v.vec_id AS kept FROM v JOIN class ON class.u = v.vec_id
"""

#: Similarities need only the numbers of shared shingles by their two counts (u, v); shingles of one side add their total.
MINHASH_SQL = rf"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}+') AS w FROM documents),
 class AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS words_id FROM word),
 shingle AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(w) < {minhash.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - {minhash.SHINGLE - 1}), lambda i: array_to_string(w[i : i + {minhash.SHINGLE - 1}], ' ')) END) AS s
   FROM class WHERE words_id = doc_id AND len(w) > 0) GROUP BY 1, 2),
 size AS (SELECT doc_id, count(*) AS k, sum(n)::DOUBLE AS t FROM shingle GROUP BY 1),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS u, b.n AS v, count(*)::DOUBLE AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
 pair AS (SELECT x, y, sum(c) AS c, sum(c * u) AS cu, sum(c * v) AS cv FROM shared GROUP BY 1, 2),
 near AS (SELECT p.x, p.y, p.c / (a.k + b.k - p.c) AS plain, a.t - p.cu AS ra, b.t - p.cv AS rb FROM pair p JOIN size a ON a.doc_id = p.x JOIN size b ON b.doc_id = p.y WHERE 10 * p.cu >= 7 * least(a.t, b.t) OR 10 * p.cv >= 7 * least(a.t, b.t) OR 10 * p.c >= 7 * least(a.k, b.k)),
 weighted AS (SELECT x, y, sum(c / (m + ra / u + rb / v)) AS p FROM (SELECT n.x, n.y, s.u, s.v, s.c, any_value(n.ra) AS ra, any_value(n.rb) AS rb, sum(o.c * greatest(o.u / s.u, o.v / s.v)) AS m
   FROM near n JOIN shared s ON s.x = n.x AND s.y = n.y JOIN shared o ON o.x = n.x AND o.y = n.y GROUP BY n.x, n.y, s.u, s.v, s.c) GROUP BY 1, 2),
 link AS (SELECT n.x, n.y FROM near n JOIN weighted w ON n.x = w.x AND n.y = w.y WHERE greatest(n.plain, w.p) >= {minhash.THRESHOLD} - 1e-12),
 both_ways AS (SELECT x AS u, y AS v FROM link UNION SELECT y, x FROM link),
 reach AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
 root AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT doc_id, words_id, coalesce(c, words_id) AS component_id, doc_id = coalesce(c, words_id) AS kept FROM class LEFT JOIN root ON root.u = class.words_id
"""

ORACLES = {"op9_minhash": MINHASH_SQL, "op1_line_dedup": LINE_DEDUP_SQL, "op4_quality_rules": QUALITY_SQL, "op7_embedding_near_dedup": VECTOR_SQL, "op10_chat_format": CHAT_SQL}
