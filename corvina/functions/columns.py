"""Column expressions: identities, paths, labels, token estimates and text splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of parsed and of raw-text languages.
PARSED = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust"}
RAW = {"html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "md": "markdown", "markdown": "markdown", "sql": "sql", "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "kt": "kotlin", "kts": "kotlin"}
#: Labels that name no real symbol.
SYNTHETIC = ["<unknown>", "<module>", "<anonymous>"]
WORDISH = "[A-Za-z0-9_]"


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(repo: Column, branch: Column, file: Column, line: Column, ordinal: Column) -> Column:
    parts = [c.cast("string") for c in (repo, branch, file, line, ordinal)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def normalized(text: Column) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def memory_id(project: Column, hashed: Column) -> Column:
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws(":", project, hashed), 256), 1, 24))


def base_memory_id(vector_id: Column) -> Column:
    """A memory's id from the id of one of its vectors."""
    return F.regexp_replace(vector_id, "_c[0-9]+$", "")


def identity_project(scope: Column, group: Column, own: Column) -> Column:
    shared = F.lower(scope).isin("global", "shared")
    return F.when(shared, F.lit("@global")).when((scope == "group") & (group != ""), F.concat(F.lit("@group:"), group)).otherwise(own)


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def short_label(symbol: Column) -> Column:
    """What follows the last '::', else the last '/', else all."""
    return F.when(symbol.contains("::"), F.substring_index(symbol, "::", -1)).when(symbol.contains("/"), F.substring_index(symbol, "/", -1)).otherwise(symbol)


def context_header(file: Column, parent: Column, name: Column) -> Column:
    """`# file > parent > name`, without a part that is empty."""
    parts = F.array(F.concat(F.lit("# "), basename(file)), F.coalesce(parent, F.lit("")), F.coalesce(name, F.lit("")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " > ")


def synthetic(symbol: Column) -> Column:
    return short_label(symbol).isin(SYNTHETIC)


def mentions(text: Column, label: Column) -> Column:
    """Whether the label stands in the text as a whole identifier; neighbours outside ASCII are boundaries."""
    quoted = F.concat(F.lit(f"(?<!{WORDISH})\\Q"), F.regexp_replace(label, r"\\E", r"\\E\\\\E\\Q"), F.lit(f"\\E(?!{WORDISH})"))
    return F.contains(text, label) & F.regexp_like(text, quoted)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = basename(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def language_of(path: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))


def list_column(text: Column) -> Column:
    """The trimmed, non-empty members of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


#: Folders that an index keeps for itself; a project with others gives its own.
OWN_FOLDERS = (".corvina", ".fastembed_cache", ".git")


def own_artifact(path: Column, folders: tuple[str, ...] = OWN_FOLDERS) -> Column:
    return F.split(path, "/")[0].isin(*folders)


#: Parts of a path that hold vendored files, parts and ends of the names of generated ones, and the longest line, in bytes, of a written one.
VENDORED = ["node_modules", "vendor", "third_party", "dist", "bower_components"]
GENERATED_PARTS, GENERATED_END, LONGEST_LINE = [".min.", ".bundle."], "-lock.json", 1000


def generated(path: Column, text: Column) -> Column:
    """Whether a machine wrote the file, by its path or by a line that no person would write."""
    name = basename(path)
    by_name = name.endswith(GENERATED_END)
    for part in GENERATED_PARTS:
        by_name = by_name | name.contains(part)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED))) | by_name | F.exists(F.split(text, "\r?\n"), lambda x: F.octet_length(x) > LONGEST_LINE)


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space, and at line ends; trimmed, none empty."""
    parts = F.split(text, r"\n|(?<=[.!?])(?=\s)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_title(title: Column | None, body: Column) -> Column:
    return body if title is None else F.when(F.coalesce(title, F.lit("")) == "", body).otherwise(F.concat(title, F.lit("\n"), body))


def memory_windows(content: Column, title: Column | None = None, size: int = 100, step: int = 70, most: int = 40) -> Column:
    """Word windows after the first one, at most `most`, each under the title if there is one."""
    words = F.split(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > step, F.sequence(F.lit(step), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.slice(starts, 1, most), lambda at: with_title(title, F.array_join(F.slice(w, at + 1, size), " ")))

    return bound(words, windows)


def joined_path(prefix: Column, path: Column) -> Column:
    parts = F.transform(F.array(prefix, path), lambda x: F.regexp_replace(x, "^/+|/+$", ""))
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda x: x != ""), "/"))


#: Extensions that make a word of prose a path, and what parts words besides white space.
PATH_EXTENSIONS = ["java", "ts", "tsx", "js", "jsx", "html", "scss", "css", "py", "rs", "go", "sql", "yaml", "yml", "xml", "properties", "kt"]
PATH_BREAKS = "`\"'()[]{},;:<>|*"


def prose_paths(text: Column) -> Column:
    """Distinct paths named in prose, in the order of their first mention."""
    breaks = "(?U)[\\s" + "".join("\\" + c for c in PATH_BREAKS) + "]+"
    words = F.transform(F.split(text, breaks), lambda w: F.regexp_replace(w, r"\.+$", ""))
    good = "^.*[^/]\\.(?:" + "|".join(PATH_EXTENSIONS) + ")$"
    return F.array_distinct(F.filter(words, lambda w: w.rlike(good)))


def noop_summary(text: Column, tokens: int) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.char_length(t) <= 4 * tokens, t).otherwise(F.concat(F.substring(t, 1, 4 * tokens), F.lit("…")))


def similarity(q: list[float], metric: str = "cosine"):
    """A Column -> Column function from vectors to their cosine or inner product with q, a matrix product for each Arrow batch.

    In double precision. A null vector, or one of another width, has no score; a zero vector has cosine 0.
    """
    one = np.asarray(q, dtype=np.float64)
    if metric == "cosine":
        one = one / (np.linalg.norm(one) or 1.0)

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), len(one)), False))
        out = np.full(len(v), np.nan)
        x = np.asarray(pc.fill_null(v.filter(pa.array(fits)).flatten(), 0.0), dtype=np.float64).reshape(-1, len(one))
        dot = x @ one
        if metric == "cosine":
            norm = np.linalg.norm(x, axis=1)
            dot = np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), 0.0)
        out[fits] = dot
        return pa.array(out, mask=~fits)

    return score


def inner_product(v: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(v, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(v: Column, q: Column) -> Column:
    """Of two columns, in double precision; 0 where either is zero."""
    norm = F.sqrt(inner_product(v, v) * inner_product(q, q))
    return F.when(norm > 0, inner_product(v, q) / norm).otherwise(F.lit(0.0))


def blend(intro: Column, chunk: Column) -> Column:
    return F.coalesce((intro + chunk) / 2, intro, chunk)
