"""Pluggable models with deterministic stand-ins: embedders, rerankers and summarizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions import columns as C

#: Vector widths by provider and model key, and the model that a service knows a key by.
LOCAL = {"minilm-l6": 384, "minilm-l12": 384, "bge-small": 384, "bge-base": 768, "ml-minilm": 384, "ml-mpnet": 768, "ml-granite": 384, "ml-granite-lg": 768}
OPENAI = {"small": 1536, "large": 3072, "ada": 1536}
VOYAGE = {"code-3": 1024, "3-lite": 512, "3": 1024}
OPENAI_NAMES = {"small": "text-embedding-3-small", "large": "text-embedding-3-large", "ada": "text-embedding-ada-002"}
VOYAGE_NAMES = {"code-3": "voyage-code-3", "3-lite": "voyage-3-lite", "3": "voyage-3"}
DEFAULT_WIDTH, INPUT_TOKENS = 384, {"ml-mpnet": 128}
PROVIDERS = {"keyword", "hash"}


def dimension_for(provider: str, model: str, custom: int | None = None) -> int:
    """The width of a model's vectors; `custom` is what a configuration says of a model that no registry knows."""
    if provider in ("openai", "voyage"):
        known, usual = (OPENAI, "small") if provider == "openai" else (VOYAGE, "code-3")
        return known.get(model, known[usual])
    return (custom or DEFAULT_WIDTH) if provider == "custom" else LOCAL.get(model, DEFAULT_WIDTH)


def service_model(provider: str, key: str) -> str:
    """The name that a service knows a model key by; an unknown key means its usual model."""
    names = {"openai": OPENAI_NAMES, "voyage": VOYAGE_NAMES}[provider]
    return names.get(key, next(iter(names.values())))


def embedder(name: str):
    """A Column -> Column function from text to a unit vector."""
    if name == "keyword":
        return keyword_embedding
    if name == "hash":
        return hash_embedding
    raise ValueError(f"unknown embedding provider: {name}")


def summarizer(name: str, require_local: bool = False, key: str | None = None):
    """Checks a summarizer's name before anything is read: only local ones where that is asked for, a service only with a key."""
    if name in ("", "extractive", "noop"):
        return name or "extractive"
    if name != "openai":
        raise ValueError(f"unknown summarizer: {name}")
    if require_local:
        raise ValueError(f"the summarizer {name} is not local")
    if not key:
        raise ValueError(f"the summarizer {name} needs a key")
    return name


def keyword_embedding(text: Column, words: tuple[str, ...] = ("auth", "database", "cache", "test")) -> Column:
    """Presence of each word, at norm 1 where any is present."""
    bound = C.bound
    hits = lambda low: F.array(*(low.contains(w).cast("float") for w in words))
    norm = lambda h: F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + x))
    scaled = lambda h, n: F.transform(h, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))
    return bound(bound(F.lower(text), hits), lambda h: bound(norm(h), lambda n: scaled(h, n)))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of hashed words, at norm 1."""
    # A value that several lambdas read is bound as the only element of an array; an expression would be computed for each element.
    bound = C.bound
    hashed = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counted = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(h, lambda c: c == i)).cast("float"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))
    return bound(hashed, lambda h: bound(counted(h), lambda v: bound(length(v), lambda n: scaled(v, n))))


def decoded_vector(vector: Column) -> Column:
    """Unknown elements are zero."""
    return F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0).cast("float")))


def response_vectors(body: Column) -> Column:
    """Vectors of an embedding service's JSON answer: data[].embedding in the order of index, or vectors[][]."""
    data = F.from_json(body, "data array<struct<index:int,embedding:array<float>>>, vectors array<array<float>>")
    return F.coalesce(F.transform(F.array_sort(data["data"]), lambda x: x["embedding"]), data["vectors"])


def reranked(pool: DataFrame, query: str, limit: int, scorer: str = "noop") -> DataFrame:
    """pool (id, score, text) with its score replaced; noop keeps the order with scores n, n-1, …; lexical counts shared words.

    Whatever the scorer does, a null score falls back to the retriever's order.
    """
    from pyspark.sql import Window

    if scorer not in ("noop", "lexical"):
        raise ValueError(f"unknown reranker: {scorer}")
    kept = F.count("*").over(Window.partitionBy()) - F.row_number().over(Window.orderBy(F.desc("score"), "id")) + 1
    if scorer == "lexical":
        words = F.array(*(F.lit(w) for w in sorted(set(query.lower().split()))))
        kept = F.coalesce(F.size(F.array_intersect(words, F.split(F.lower("text"), r"\W+"))), F.lit(0))
    return pool.withColumn("score", kept.cast("double")).orderBy(F.desc("score"), "id").limit(limit)
