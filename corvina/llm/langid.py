"""Language identification by string kernels.

A text is the set of its character n-grams of one to four characters, lower-cased (a blended spectrum, presence only).
The kernel of two texts is the number of n-grams they share, divided by the root of the
product of their numbers. Landmarks (Nyström) stand for the training rows: phi(x) = K(x, landmarks)
K(landmarks, landmarks)^(-1/2), taken at norm 1, and one-versus-rest ridge regression on phi gives a value for each
language. Scoring is batched: presence rows over the n-grams of the landmarks times landmark columns, times weights.

At norm 1 phi does not depend on how many n-grams a text has outside of those of the landmarks. The presence of
n-grams says less and less the longer a text is, so a long one is cut into equal segments of at most SEGMENT characters
that overlap by three, all of them are scored, and their values are averaged: a text is judged alike at every length.
Texts unlike all training rows are told by their coverage, the share of their n-grams of two characters that any
landmark holds; the score is the ridge value mapped to 0..1, times the coverage.

The model is fitted on a bounded sample: at most PER_LANGUAGE labelled training rows for each of the MOST_LANGUAGES
commonest languages, drawn evenly by a hash, texts over SAMPLED_CHARS only where a language has no others. The first
of them are the landmarks, whose n-grams reach the driver; of the others only their kernels with the landmarks do.

Cases: null text and texts without a letter get `und` and score 0. Rows with a null language teach nothing. Without
any training row every text gets `und`. Equal texts get equal answers. Very long texts are read whole, segment by segment.
Columns of any other names pass through or are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import chunks, quiet_numpy, quoted, written

ORDERS = (1, 2, 3, 4)
COVERED = 2
#: Bounds of the fit: sampled rows and landmarks for each language, languages in all, characters of an ordinary sampled text.
PER_LANGUAGE, LANDMARKS, MOST_LANGUAGES, SAMPLED_CHARS = 200, 16, 500, 20_000
RIDGE = 1e-2
UNKNOWN = "und"
#: Characters of a segment and of the texts of one pass, and cells of a presence matrix.
SEGMENT, PASS, CELLS = 20_000, 200_000, 1 << 25


def grams(points: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of all n-grams inside documents; doc is the document of each code point."""
    k = len(points) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    with quiet_numpy():
        code = np.full(k, n, dtype=np.uint64)
        for j in range(n):
            code = (code ^ points[j : j + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    inside = doc[:k] == doc[n - 1 :]
    return doc[:k][inside], code[inside]


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document of each) of the lower-cased texts."""
    lower = [t.lower() for t in texts]
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lower), dtype=np.int64, count=len(texts)))
    return np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), doc


def segments(text: str) -> list[str]:
    many = -(-len(text) // SEGMENT)
    if many < 2:
        return [text]
    size = -(-len(text) // many)
    return [text[k : k + size + ORDERS[-1] - 1] for k in range(0, len(text), size)]


def gram_set(text: str) -> np.ndarray:
    """The distinct n-gram codes of a text, sorted."""
    points, doc = read([text])
    return np.unique(np.concatenate([grams(points, doc, n)[1] for n in ORDERS]))


class Columns:
    """Numbers of n-gram codes, by a table with linear probing that numpy reads for a whole batch at once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        slot, todo = self._slot(codes), np.arange(len(codes))
        while len(todo):
            free = self.table[slot[todo]] < 0
            self.table[slot[todo[free]]] = todo[free]
            todo = todo[self.table[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        # What a place holds; an empty one holds 0, whose own place is the first, and there nothing but 0 itself equals it.
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.keys[slot] = codes

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).view(np.int64)

    def __getstate__(self):
        return self.codes

    def __setstate__(self, codes):
        self.__init__(codes)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code, -1 where there is none."""
        slot = self._slot(codes)
        at = self.table[slot]
        hit = (self.keys[slot] == codes) & (at >= 0)
        out = np.where(hit, at, np.int32(-1))
        todo = np.flatnonzero(~hit & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = self.table[slot[todo]]
            hit = (at >= 0) & (self.keys[slot[todo]] == codes[todo])
            out[todo[hit]] = at[hit]
            todo = todo[(at >= 0) & ~hit]
        return out


@dataclass
class Landmarks:
    """The n-grams of the landmarks: numbered columns, for each a row of bits that says which landmarks hold it."""

    columns: Columns
    bits: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(sets: list[np.ndarray]) -> Landmarks:
        codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        held = np.zeros((len(codes), -(-max(len(sets), 1) // 8)), dtype=np.uint8)
        for k, own in enumerate(sets):
            held[np.searchsorted(codes, own), k // 8] |= np.uint8(128 >> k % 8)
        return Landmarks(Columns(codes), held, np.array([max(len(s), 1) for s in sets], dtype=np.float64))

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x landmarks: shared n-grams over the root of the landmark's number, coverage of each text)."""
        out, covered = np.zeros((len(texts), len(self.sizes))), np.zeros(len(texts))
        step = max(1, min(128, CELLS // max(1, len(self.columns.codes))))
        group = np.cumsum([len(t) for t in texts]) // PASS * len(texts) + np.arange(len(texts)) // step
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if texts else []
        for lo, hi in zip(cuts, cuts[1:]):
            part = texts[lo:hi]
            documents, numbers = [], []
            known, total = np.zeros(len(part)), np.zeros(len(part))
            points, doc = read(part)
            for n in ORDERS:
                d, code = grams(points, doc, n)
                column = self.columns.find(code)
                hit = column >= 0
                documents.append(d[hit])
                numbers.append(column[hit])
                if n == COVERED:
                    known += np.bincount(documents[-1], minlength=len(part))
                    total += np.bincount(d, minlength=len(part))
            document, number = np.concatenate(documents), np.concatenate(numbers)
            # Only n-grams that this batch has are columns of its presence rows.
            mark = np.zeros(len(self.columns.codes), dtype=bool)
            mark[number] = True
            used = np.flatnonzero(mark)
            place = np.cumsum(mark) - 1
            there = np.zeros((len(part), len(used)), dtype=np.float32)
            there.reshape(-1)[document * len(used) + place[number]] = 1
            held = np.unpackbits(self.bits[used], axis=1, count=len(self.sizes)).astype(np.float32)
            out[lo:hi] = there @ held
            # A text of one character has no pair of characters; its only n-gram decides.
            covered[lo:hi] = np.where(total > 0, known / np.maximum(total, 1), np.bincount(document, minlength=len(part)) > 0)
        return out / np.sqrt(self.sizes), covered


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    landmarks: Landmarks | None = None
    half: np.ndarray | None = None  # K(landmarks, landmarks)^(-1/2), without null directions
    solution: np.ndarray | None = None

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages ridge values, coverage): the means over the segments of each text."""
        parts = [segments(t) for t in texts]
        many = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(many) - many
        kernel, covered = self.landmarks.kernels([x for p in parts for x in p])
        values = unit(kernel @ self.half) @ self.solution
        return np.add.reduceat(values, first, axis=0) / many[:, None], np.add.reduceat(covered, first) / many


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def whitened(landmarks: Landmarks, sets: list[np.ndarray]) -> np.ndarray:
    """K(landmarks, landmarks)^(-1/2) for landmarks of these n-gram sets."""
    number = [landmarks.columns.find(s) for s in sets]
    held = np.unpackbits(landmarks.bits, axis=1, count=len(sets))
    shared = np.array([held[k].sum(axis=0, dtype=np.int64) for k in number], dtype=np.float64)
    value, vector = np.linalg.eigh(shared / np.sqrt(landmarks.sizes[:, None] * landmarks.sizes[None, :]))
    good = value > 1e-6 * value.max()
    return vector[:, good] / np.sqrt(value[good])


def fit(kernel: np.ndarray, labels: list[str], landmarks: Landmarks, half: np.ndarray, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström features at norm 1; each language weighs the same, however many rows it has."""
    languages = sorted(set(labels))
    of = np.array([languages.index(x) for x in labels])
    phi = unit(kernel @ half)
    weight = (1.0 / np.bincount(of, minlength=len(languages)))[of][:, None]
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solution = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return Model(languages, landmarks, half, solution)


def train(df: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows for which `trains` holds; the sample is bounded by per_language and MOST_LANGUAGES."""
    spark = df.sparkSession
    key = F.coalesce(df[id_col].cast("string"), F.lit(""))
    hashed = F.pmod(F.xxhash64(key, df[text_col].cast("string"), F.lit("sample")), F.lit(1 << 40))
    rows = df.where(trains & df[lang_col].isNotNull() & df[text_col].isNotNull()).select(df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"), hashed.alias("h"))
    ordinary = F.char_length("text") <= SAMPLED_CHARS
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ordinary).alias("few"))
    counts = {r["lang"]: r["few"] or r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    long_only = [r["lang"] for r in counted.where("few = 0").orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if not counts:
        return Model()
    # A threshold for each language makes about twice the sample; the exact bound is applied to what came of it. Rows that
    # are equal in id and text are drawn once, so no tie can outgrow the sample; where they leave too few, the threshold rises.
    share = {k: 2 * per_language / n for k, n in counts.items()}
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))
    while True:
        pairs = [x for k, s in share.items() for x in (F.lit(k), F.lit(int(min(1.0, s) * (1 << 40))))]
        limit = F.create_map(*pairs)[F.col("lang")]
        drawn = rows.where((F.col("h") < limit) & (ordinary | F.col("lang").isin(long_only))).select("lang", "h", F.xxhash64("text").alias("t"), "text").dropDuplicates(["lang", "h", "t"])
        # Bounded by per_language and MOST_LANGUAGES, so it is written once and read again.
        sample = written(drawn.withColumn("place", place).where(F.col("place") <= per_language), "language-sample")
        have = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [k for k, s in share.items() if s < 1 and have.get(k, 0) < per_language]
        if not short:
            break
        share |= {k: 16 * share[k] for k in short}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([gram_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["lang", "place", "grams"])

    marks = sample.where(F.col("place") <= LANDMARKS).select("lang", "text", "place").mapInArrow(sets, "lang string, place int, grams binary").collect()
    own = [np.frombuffer(r["grams"], dtype=np.uint64) for r in sorted(marks, key=lambda r: (r["lang"], r["place"]))]
    landmarks = Landmarks.of(own)
    shared = spark.sparkContext.broadcast(landmarks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            kernel = shared.value.kernels(b.column(1).to_pylist())[0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k.tobytes() for k in kernel], pa.binary())], ["lang", "place", "kernel"])

    got = sorted(sample.select("lang", "text", "place").mapInArrow(kernels, "lang string, place int, kernel binary").collect(), key=lambda r: (r["lang"], r["place"]))
    return fit(np.array([np.frombuffer(r["kernel"]) for r in got]), [r["lang"] for r in got], landmarks, whitened(landmarks, own))


def predictions(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
    if known:
        got, covered = model.scores([texts[i] for i in known])
        best, value = got.argmax(axis=1), covered * np.clip((1 + got.max(axis=1)) / 2, 0, 1)
        for i, k, s in zip(known, best.tolist(), value.tolist()):
            lang[i], score[i] = model.languages[k], s
    return lang, score


def told(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of df as c0, c1, … in their order, so that no name matters, with lang_pred and score of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES, LANDMARKS and the sampled texts
    at, plain = df.columns.index(text_col), df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    slim = plain.withColumn("text", F.col(f"c{at}").cast("string")) if plain.schema[at].dataType != T.StringType() else plain
    source = "text" if "text" in slim.columns else f"c{at}"
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, source):
            lang, score = predictions(b.column(b.schema.get_field_index(source)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - 2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.fieldNames())

    return slim.mapInArrow(run, schema)


def predict(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of df, which may hold the text, with lang_pred and score of each whole text."""
    names = [text_col, *(k for k in keep if k != text_col)]
    done = told(df.select(*(df[quoted(k)] for k in names)), model, text_col)
    return done.select(*(F.col(f"c{names.index(k)}").alias(k) for k in keep), "lang_pred", "score")


def held_out(df: DataFrame, id_col: str = "doc_id"):
    """The fold that is never trained on: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
