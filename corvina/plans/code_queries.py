"""Queries over generated source files: parsing, chunking, routes, and the writes that follow a change of files.

The given tables hold no code, so `part` and `pages` are written out as small source files of known shape; the SQL forms
state what must be found in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import chunking, models, parsing
from corvina.operators import budget, memory, state
from corvina.plans.projections import frame, oracle
from corvina.sources.tables import spread, table

#: Source files in SQL that both engines read; ~ is a line break.
PYTHON = (
    "SELECT 'src/f' || cast(p_partkey AS string) || '.py' AS file, 'python' AS language, cast(p_partkey AS string) AS k, cast(p_partkey % 7 AS string) AS m, replace('import os~from a.b import c~~class Card' || cast(p_partkey % 7 AS string) || ':~    def charge(self, x: Other):~"
    "        self.settle()~        x.run()~    def settle(self):~        return 1~~def part' || cast(p_partkey AS string) || '(c: Card' || cast(p_partkey % 7 AS string) || '):~    c.charge()', '~', chr(10)) AS text FROM part"
)

WEB = [
    # extension, text with {n} for the page's number
    ("py", "from fastapi import FastAPI~@app.get ('/p{n}')~async def page{n}():~    return 1~@other.get('/no')~def no():~    pass"),
    ("py", "from flask import Flask~@app.route('/p{n}', methods=['GET', 'post'])~def page{n}():~    pass~@app.route('/q{n}', methods=[])~def more{n}():~    pass"),
    ("js", "const express = require('express')~router.post('/p{n}',~  shop.page{n},~  last)~api.get('/no', x)~app.all('/q{n}', (req, res) => 1)~"),
    ("ts", "import { Controller } from '@nestjs/common'~@Controller('shop')~export class Shop {~  @Get('p{n}')~  page{n}() {}~}"),
    ("java", '@RequestMapping("/shop")~class Shop {~  @GetMapping("/p{n}")~  @ Allowed("x")~  String page{n}() {}~}'),
    ("java", 'import jakarta.ws.rs.GET;~@Path("/shop")~class Shop {~  @GET~  @Path("/p{n}")~  String page{n}() {}~}'),
    ("ts", "import { Routes } from '@angular/router'~const routes: Routes = [{ path: 'p{n}' }]"),
]


def python_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PYTHON.replace("FROM part", "FROM {part}"), part=spread(table(spark, d, "part").select("p_partkey")))


def web_files(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("page_id") % len(WEB)
    pick = lambda at: F.element_at(F.array(*(F.lit(w[at]) for w in WEB)), (kind + 1).cast("int"))
    number = F.col("page_id").cast("string")
    return spread(table(spark, d, "pages").select("page_id")).select(F.concat(F.lit("web"), number, F.lit("."), pick(0)).alias("file"), F.replace(F.replace(pick(1), F.lit("{n}"), number), F.lit("~"), F.lit("\n")).alias("text"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of every file."""
    return parsing.parsed_files(python_files(spark, d)).select("file", F.explode("symbols").alias("s")).select("file", "s.name", "s.kind", F.col("s.start").alias("first"), F.col("s.end").alias("last"), "s.parent")


def imports(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed_files(python_files(spark, d)).select("file", F.posexplode("imports").alias("pos", "module"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Call edges with qualified targets."""
    return parsing.parsed_files(python_files(spark, d)).select("file", F.explode("edges").alias("e")).select("file", "e.source", "e.target", "e.line")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked_files(python_files(spark, d), ["python"]).select("file", "ordinal", "level", "name", F.col("start").alias("first"), F.col("end").alias("last"), "text")


def raw_cover(spark: SparkSession, d: str) -> DataFrame:
    """For each text read as raw text: whether it is one chunk, and the lines that its chunks cover without a gap."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("markdown").alias("language"), "text")
    got = chunking.chunked_files(files, [])
    ranges = F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))))
    reach = F.aggregate("r", F.lit(0), lambda upto, x: F.when(x["a"] <= upto + 1, F.greatest(upto, x["b"])).otherwise(upto))
    done = got.groupBy("file").agg(ranges.alias("r"), F.min("level").alias("level"), F.count_if(F.col("name") == F.col("file")).alias("named"), F.count("*").alias("n"), F.max("end").alias("last"))
    return done.select(F.col("file").cast("long").alias("doc_id"), (F.col("level") == "file").alias("whole"), reach.alias("covered"), "last", (F.col("named") == F.col("n")).alias("named"))


def found_routes(spark: SparkSession, d: str) -> DataFrame:
    return parsing.extracted_routes(web_files(spark, d))


def reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors after the notes of every third conversation were written again."""
    notes = frame(spark, d, "memories").select("id", "topic", "content")
    stale = notes.select(F.concat("id", F.lit("_c200")).alias("id")).unionByName(notes.select("id"))
    stale = stale.withColumn("vector", models.hash_embedding(F.lit("old")))
    after = memory.reindexed(stale, notes.where("id RLIKE '^mem_[0-9]*3x'"), models.hash_embedding)
    return after.select("id", F.size("vector").alias("dim"))


def renamed(spark: SparkSession, d: str) -> DataFrame:
    """Index rows after the files of one hash moved to another folder."""
    states = frame(spark, d, "states")
    moves = states.where("hash = '3'").select("repo", "branch", "file", F.concat(F.lit("moved/"), "file").alias("new_file")).distinct()
    return state.renamed_files(states, moves).groupBy("repo", "branch", "file").agg(F.count("*").alias("n"))


def shortened(spark: SparkSession, d: str) -> DataFrame:
    """Every text cut to whole lines within a share of 128 tokens."""
    return table(spark, d, "documents").select("doc_id", budget.shortened(F.col("text"), F.lit(128)).alias("short"))


def note_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text of every note that is embedded, whole."""
    notes = frame(spark, d, "memories").select("id", "topic", F.col("content"))
    long = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("topic"), F.col("text").alias("content"))
    return memory.note_texts(notes.unionByName(long)).select("id", "level", "text")


#: For each further language a file of one type with two methods and, where it has them, a function; {n} is a number.
CODE = {
    "java": "package a;~import java.util.List;~~public class Card{n} {~    public int charge(Other x) {~        this.settle();~        x.run();~        return new Tax().total(1);~    }~    void settle() {~    }~}",
    "typescript": "import { Other } from './other'~~export class Card{n} {~  charge(x: Other): number {~    this.settle()~    x.run()~    return new Tax().total(1)~  }~  settle() {~  }~}~~export function part{n}(c: Card{n}) {~  c.charge()~}",
    "javascript": "import { Other } from './other'~~class Card{n} {~  charge(x) {~    this.settle()~    x.run()~  }~  settle() {~  }~}~~async function part{n}(c) {~  c.charge()~}",
    "go": "package a~~import (~\t\"fmt\"~)~~type Card{n} struct {~}~~func (c Card{n}) Charge(x Other) {~\tc.Settle()~\tx.Run()~}~~func part{n}(p *Card{n}) {~\tp.Charge()~}",
    "rust": "use a::b::Other;~~pub struct Card{n} {~}~~impl Card{n} {~    pub fn charge(&self, x: Other) {~        self.settle();~        x.run();~    }~    fn settle(&self) {~    }~}~~fn part{n}(c: Card{n}) {~    c.charge();~}",
    "tsx": "import React from 'react'~~interface Props{n} {~  a: number~}~~export function View{n}(p: Props{n}) {~  return draw(p)~}",
}


def code_files(spark: SparkSession, d: str) -> DataFrame:
    names = list(CODE)
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    number = F.col("p_partkey").cast("string")
    return spread(table(spark, d, "part").select("p_partkey")).select(number.alias("file"), pick(names).alias("language"), F.replace(F.replace(pick(CODE.values()), F.lit("{n}"), number), F.lit("~"), F.lit("\n")).alias("text"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed_files(code_files(spark, d)).select("file", F.explode("symbols").alias("s")).select("file", "s.name", "s.kind", F.col("s.start").alias("first"), F.col("s.end").alias("last"), "s.parent")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsing.parsed_files(code_files(spark, d))
    calls = parsed.select("file", F.explode("edges").alias("e")).select("file", F.lit("call").alias("what"), "e.source", "e.target", "e.line")
    return calls.unionByName(parsed.select("file", F.lit("import").alias("what"), F.explode("imports").alias("source"), F.lit("").alias("target"), F.lit(0).alias("line")))


_SYMBOLS = {
    "java": [("Card", "class", 4, 12, ""), ("charge", "method", 5, 9, "Card"), ("settle", "method", 10, 11, "Card")],
    "typescript": [("Card", "class", 3, 11, ""), ("charge", "method", 4, 8, "Card"), ("settle", "method", 9, 10, "Card"), ("part", "function", 13, 15, "")],
    "javascript": [("Card", "class", 3, 10, ""), ("charge", "method", 4, 7, "Card"), ("settle", "method", 8, 9, "Card"), ("part", "function", 12, 14, "")],
    "go": [("Card", "type", 7, 8, ""), ("Charge", "method", 10, 13, ""), ("part", "function", 15, 17, "")],
    "rust": [("Card", "struct", 3, 4, ""), ("charge", "method", 7, 10, "Card"), ("settle", "method", 11, 12, "Card"), ("part", "function", 15, 17, "")],
    "tsx": [("Props", "interface", 3, 5, ""), ("View", "function", 7, 9, "")],
}
_CALLS = {
    "java": [("Card{n}.charge", "Card{n}.settle", 6), ("Card{n}.charge", "Other.run", 7), ("Card{n}.charge", "total", 8)],
    "typescript": [("Card{n}.charge", "Card{n}.settle", 5), ("Card{n}.charge", "Other.run", 6), ("Card{n}.charge", "total", 7), ("part{n}", "Card{n}.charge", 14)],
    "javascript": [("Card{n}.charge", "Card{n}.settle", 5), ("Card{n}.charge", "run", 6), ("part{n}", "charge", 13)],
    "go": [("Charge", "Card{n}.Settle", 11), ("Charge", "Other.Run", 12), ("part{n}", "Charge", 16)],
    "rust": [("Card{n}.charge", "Card{n}.settle", 8), ("Card{n}.charge", "Other.run", 9), ("part{n}", "Card{n}.charge", 16)],
    "tsx": [("View{n}", "draw", 8)],
}
_IMPORTED = {"java": "import java.util.List;", "typescript": "import { Other } from ''./other''", "javascript": "import { Other } from ''./other''", "go": 'import (~\t"fmt"~)', "rust": "use a::b::Other;", "tsx": "import React from ''react''"}


def _code_symbols_sql() -> str:
    named = lambda x: f"'{x}' || n" if x in ("Card", "part", "Props", "View") else f"'{x}'"
    rows = [f"SELECT n AS file, {named(a)} AS name, '{b}' AS kind, {c} AS first, {e} AS last, {named(p)} AS parent FROM f WHERE k = {i}" for i, x in enumerate(CODE) for a, b, c, e, p in _SYMBOLS[x]]
    return f"WITH f AS (SELECT p_partkey::VARCHAR AS n, p_partkey % {len(CODE)} AS k FROM part) " + " UNION ALL ".join(rows)


def _code_edges_sql() -> str:
    rows = [f"SELECT n AS file, 'call' AS what, replace('{a}', '{{n}}', n) AS source, replace('{b}', '{{n}}', n) AS target, {c} AS line FROM f WHERE k = {i}" for i, x in enumerate(CODE) for a, b, c in _CALLS[x]]
    rows += [f"SELECT n, 'import', replace('{_IMPORTED[x]}', '~', chr(10)), '', 0 FROM f WHERE k = {i}" for i, x in enumerate(CODE)]
    return f"WITH f AS (SELECT p_partkey::VARCHAR AS n, p_partkey % {len(CODE)} AS k FROM part) " + " UNION ALL ".join(rows)


QUERIES = {
    "T1_symbols_by_patterns": code_symbols, "T1_T2_calls_by_patterns": code_edges,
    "M2_T9_note_texts": note_texts,
    "T1_symbols": symbols, "T1_imports": imports, "T2_call_edges": call_edges, "T3_T7b_chunks": chunks, "T8_raw_chunks": raw_cover, "T14_T22_T24_routes": found_routes,
    "M2_M3_reindexed": reindexed, "M16_renamed_files": renamed, "R3_shortened": shortened,
}

_ROUTE = "SELECT 'web' || page_id || '.{ext}' AS file, '{kind}' AS framework, '{verb}' AS http_method, '{path}p' || page_id AS path, {symbol} AS handler_symbol, {method} AS handler_method, {line} AS line FROM pages WHERE page_id % 7 = {k}"
_PLAIN, _OWNED, _NONE = ("'page' || page_id", "'page' || page_id"), ("'Shop.page' || page_id", "'page' || page_id"), ("''", "''")
_MEMBER = ("'shop.page' || page_id", "'page' || page_id")
_EXPECTED = [
    (0, "fastapi", "GET", "/", _PLAIN, 2), (1, "flask", "GET", "/", _PLAIN, 2), (1, "flask", "POST", "/", _PLAIN, 2), (2, "express", "POST", "/", _MEMBER, 2),
    (3, "nestjs", "GET", "/shop/", _OWNED, 4), (4, "spring", "GET", "/shop/", _OWNED, 3), (5, "quarkus", "GET", "/shop/", _OWNED, 4), (6, "angular", "", "/", _NONE, 2),
]

ORACLES = {
    "T1_symbols_by_patterns": _code_symbols_sql(), "T1_T2_calls_by_patterns": _code_edges_sql(),
    "T1_symbols": f"""WITH f AS ({PYTHON}) SELECT file, 'Card' || m AS name, 'class' AS kind, 4 AS first, 9 AS last, '' AS parent FROM f
    UNION ALL SELECT file, 'charge', 'method', 5, 7, 'Card' || m FROM f UNION ALL SELECT file, 'settle', 'method', 8, 9, 'Card' || m FROM f UNION ALL SELECT file, 'part' || k, 'function', 11, 12, '' FROM f""",
    "T1_imports": f"WITH f AS ({PYTHON}) SELECT file, 0 AS pos, 'import os' AS module FROM f UNION ALL SELECT file, 1, 'from a.b import c' FROM f",
    "T2_call_edges": f"""WITH f AS ({PYTHON}) SELECT file, 'Card' || m || '.charge' AS source, 'Card' || m || '.settle' AS target, 6 AS line FROM f
    UNION ALL SELECT file, 'Card' || m || '.charge', 'Other.run', 7 FROM f UNION ALL SELECT file, 'part' || k, 'Card' || m || '.charge', 12 FROM f""",
    "T3_T7b_chunks": f"""WITH f AS (SELECT *, string_split(text, chr(10)) AS l FROM ({PYTHON})) SELECT file, 0 AS ordinal, 'file' AS level, 'f' || k || '.py' AS name, 1 AS first, 12 AS last,
      replace('# File: f' || k || '.py~# Imports:~import os~from a.b import c~# Symbols:~- Card' || m || ' (class)~- charge (method)~- settle (method)~- part' || k || ' (function)~', '~', chr(10)) AS text FROM f
    UNION ALL SELECT file, 1, 'class', 'Card' || m, 4, 9, 'class Card' || m || ':' || chr(10) || '# methods: charge, settle' FROM f
    UNION ALL SELECT file, 2, 'function', 'charge, settle, part' || k, 5, 12, '# f' || k || '.py > Card' || m || ' > charge' || chr(10) || ltrim(array_to_string(l[5:7], chr(10))) || chr(10) || chr(10)
      || '# f' || k || '.py > Card' || m || ' > settle' || chr(10) || ltrim(array_to_string(l[8:9], chr(10))) || chr(10) || chr(10) || '# f' || k || '.py > part' || k || chr(10) || array_to_string(l[11:12], chr(10)) FROM f""",
    "T8_raw_chunks": r"SELECT doc_id, len(text) // 4 <= 512 AS whole, n AS covered, n AS last, true AS named FROM (SELECT doc_id, text, (len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END)::INT AS n FROM documents) WHERE regexp_matches(text, '[^\s]')",
    "T14_T22_T24_routes": " UNION ALL ".join(_ROUTE.format(k=k, ext=WEB[k][0], kind=kind, verb=verb, path=path, symbol=names[0], method=names[1], line=line) for k, kind, verb, path, names, line in _EXPECTED)
    + " UNION ALL SELECT 'web' || page_id || '.py', 'flask', 'GET', '/q' || page_id, 'more' || page_id, 'more' || page_id, 5 FROM pages WHERE page_id % 7 = 1 UNION ALL SELECT 'web' || page_id || '.js', 'express', 'ALL', '/q' || page_id, '', '', 6 FROM pages WHERE page_id % 7 = 2",
    "M2_T9_note_texts": oracle(
        r""", n AS (SELECT id, topic, content FROM memories UNION ALL SELECT 'doc_' || doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, text FROM documents),
        w AS (SELECT id, topic, regexp_split_to_array(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM n), p AS (SELECT id, topic, w, unnest(generate_series(1, 40)) AS i FROM w)
        SELECT id, 'memory' AS level, CASE WHEN topic <> '' THEN topic || chr(10) ELSE '' END || content AS text FROM n
        UNION ALL SELECT id || '_c' || i, 'memory_chunk', CASE WHEN topic <> '' THEN topic || chr(10) ELSE '' END || array_to_string(w[i * 70 + 1 : i * 70 + 100], ' ') FROM p WHERE i * 70 < len(w)""",
        "memories",
    ),
    "M2_M3_reindexed": oracle(
        r"""SELECT id, 64 AS dim FROM memories UNION ALL SELECT id || '_c200', 64 FROM memories WHERE NOT regexp_matches(id, '^mem_[0-9]*3x')
        UNION ALL SELECT id || '_c' || i, 64 FROM (SELECT id, len(regexp_split_to_array(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+')) AS n, unnest(generate_series(1, 40)) AS i FROM memories WHERE regexp_matches(id, '^mem_[0-9]*3x')) WHERE 70 * i < n""",
        "memories",
    ),
    "M16_renamed_files": oracle(
        "SELECT s.repo, s.branch, CASE WHEN m.file IS NULL THEN s.file ELSE 'moved/' || s.file END AS file, count(*) AS n FROM states s LEFT JOIN (SELECT DISTINCT repo, branch, file FROM states WHERE hash = '3') m ON s.repo = m.repo AND s.branch = m.branch AND s.file = m.file GROUP BY 1, 2, 3",
        "states",
    ),
    "R3_shortened": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents),
    s AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l)
    SELECT doc_id, coalesce(nullif(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE upto <= 512), '') || chr(10), '') || '… (shortened)' AS short FROM s GROUP BY doc_id""",
}
