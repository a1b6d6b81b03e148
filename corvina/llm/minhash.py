"""Near-duplicate documents by ProbMinHash.

A document is its five-word shingles (words of the lower-cased text), weighted by how often each occurs; a shorter
document is one shingle. Every shingle is a Poisson process whose rate is its weight and whose points fall into
SIGNATURE registers; a register keeps the shingle of its earliest point. Two documents agree in a register with
the probability Jaccard similarity of their weights. Points come in order of time, so a document stops early: only
points before a horizon of about SIGNATURE * (ln SIGNATURE + 4) points in all are made, whatever its length, and the
few documents with an empty register go on with a doubled horizon. A document that repeats a shingle has a second
signature, of its shingles without their counts, for the plain Jaccard similarity; without repeats the two are equal.

Documents with equal words form a class, represented by its least id; one of each class goes on. Registers of
both signatures are banded alike. Every bucket, whatever its size, is tied to LEADERS of its members; when links then
leave it in more than one component, prefix filters over rare shingles, one for each similarity and both exact, find
the candidates between its components, so nothing is dropped. Pairs are verified on their whole shingle sets: a link needs a similarity of
THRESHOLD, probability Jaccard or plain Jaccard. Classes are the components of the links.

Cases: texts without a word (null, empty, blank) link with nothing. Equal rows are copies of one another. A row
without an id links with nothing and stays. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import chunks, cleared, mark, quiet_numpy, written
from corvina.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
SIGNATURE = BANDS * ROWS
#: Texts of one numpy pass, and what a document's points count in bytes of text: some thousand are made for the shortest one, too.
PASS_BYTES, ROW_BYTES = 400_000, 2000
#: Leaders of a bucket.
LEADERS = 2
#: Read by nothing: up to so many members a bucket once went another way. Tests still set it.
SMALL = 32
#: Cells of the hashed document frequencies.
CELL_BITS = 20
CELLS, CELL_SHIFT = 1 << CELL_BITS, np.uint64(64 - CELL_BITS)

#: Bytes whose words are hashed at a time.
SECTION = 1 << 20
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sections(raw: bytes) -> list[bytes]:
    """A long text in parts of at least SECTION bytes, cut at white space."""
    if len(raw) <= SECTION:
        return [raw]
    out, at = [], 0
    while at < len(raw):
        found = _BLANK.search(raw, at + SECTION)
        stop = found.end() if found else len(raw)
        out.append(raw[at:stop])
        at = stop
    return out


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after another, the number of words of each text). About SECTION bytes are read at a time."""
    parts = [(k, p) for k, r in enumerate(raw) for p in sections(r)]
    group = np.cumsum([len(p) for _, p in parts]) // SECTION if parts else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(parts)]
    words, sizes = [np.zeros(0, dtype=np.uint64)], np.zeros(len(raw), dtype=np.int64)
    with quiet_numpy():
        for lo, hi in zip(cuts, cuts[1:]):
            own = [p for _, p in parts[lo:hi]]
            data = np.frombuffer(b"\n".join(own) + b"\n", dtype=np.uint8)
            ends = np.cumsum([len(p) + 1 for p in own])
            power = np.cumprod(np.full(len(data), _BASE, dtype=np.uint64))
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
            blank = np.concatenate([[True], _SPACE[data]])
            start, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
            inverse = np.cumprod(np.full(len(data), _INVERSE, dtype=np.uint64))
            words.append(mix((prefix[stop] - prefix[start]) * inverse[start]))
            np.add.at(sizes, [k for k, _ in parts[lo:hi]], np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(own)))
    return np.concatenate(words), sizes


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted by document, then hash, over all texts."""
    word, sizes = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    n = len(word)
    with quiet_numpy():
        # Short documents are padded to one shingle with a word of their own kind.
        take = np.maximum(sizes - SHINGLE + 1, np.minimum(sizes, 1))
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(take)])[:-1], take) + np.arange(int(take.sum()))
        own = np.repeat(np.arange(len(texts)), take)
        last = np.repeat(first + sizes, take)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(SHINGLE):
            there = at + k < last
            h = mix(h + np.uint64(k + 1) + np.where(there, word[np.minimum(at + k, max(n - 1, 0))] if n else np.uint64(0), np.uint64(0x5851F42D4C957F2D)))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _points(h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The waiting time (rate 1) and the register of point `number` of each shingle."""
    r = mix(h + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    wait = -np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) / float(1 << 40))
    return wait, (((r & np.uint64(0xFFFFFF)) * np.uint64(SIGNATURE)) >> np.uint64(24)).astype(np.int64)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, documents: int) -> np.ndarray:
    """documents x SIGNATURE shingle hashes; rows of documents without shingles are zero."""
    total = np.bincount(doc, weights=weight, minlength=documents)
    out = np.zeros(documents * SIGNATURE, dtype=np.uint64)
    best = np.full(documents * SIGNATURE, np.inf)
    horizon = SIGNATURE * (np.log(SIGNATURE) + 4)
    todo = np.flatnonzero(total > 0)
    with quiet_numpy():
        while len(todo):
            wanted = np.zeros(documents, dtype=bool)
            wanted[todo] = True
            pick = wanted[doc]
            d, e, w = doc[pick], h[pick], weight[pick].astype(np.float64)
            end = horizon / total[d]
            time, number = np.zeros(len(d)), np.zeros(len(d), dtype=np.int64)
            rounds = 0
            while len(d):
                # A few points one by one, then as many at once as are still expected.
                more = np.ones(len(d), dtype=np.int64) if rounds < 3 else np.ceil((end - time) * w * 1.1 + 4).astype(np.int64)
                owner = np.repeat(np.arange(len(d)), more)
                first = np.cumsum(more) - more
                step = np.arange(len(owner)) - first[owner]
                wait, register = _points(e[owner], number[owner] + step)
                run = np.cumsum(wait / w[owner])
                at = run - np.concatenate([[0.0], run])[first][owner] + time[owner]
                early = at < end[owner]
                slot, when, who = (d[owner] * SIGNATURE + register)[early], at[early], e[owner][early]
                np.minimum.at(best, slot, when)
                won = best[slot] == when
                out[slot[won]] = who[won]
                time, number = at[first + more - 1], number + more
                alive = time < end
                d, e, w, end, time, number = d[alive], e[alive], w[alive], end[alive], time[alive], number[alive]
                rounds += 1
            todo = todo[np.isinf(best.reshape(documents, SIGNATURE)[todo]).any(axis=1)]
            horizon *= 2
    return out.reshape(documents, SIGNATURE)


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted sets with sorted hashes."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0.0
    plain = len(i) / (len(h1) + len(h2) - len(i))
    a, b = w1[i].astype(float), w2[j].astype(float)
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    # Elements of one side only lie at ratio zero or infinity.
    left = np.cumsum(a) + (w1.sum() - a.sum())
    right = b.sum() - np.cumsum(b) + (w2.sum() - b.sum())
    upto = np.searchsorted(ratio, ratio, side="right") - 1
    return float((1 / (left[upto] / a + right[upto] / b)).sum()), plain


def _words_digest(text: str) -> bytes | None:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _band_keys(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, documents: int) -> np.ndarray:
    """documents x BANDS keys of the banded signatures."""
    sig = signatures(doc, h, weight, documents).reshape(documents, BANDS, ROWS)
    with quiet_numpy():
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (documents, BANDS)).copy()
        for k in range(ROWS):
            key = mix(key * np.uint64(3) + sig[:, :, k])
    return key


def bands(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words binary, bands array<long>) of every whole text; words is null without a word.

    The bands are those of the counted shingles, then those of the plain set that differ from them.
    """
    slim = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", PASS_BYTES, ROW_BYTES):
            texts = [t or "" for t in b.column(1).to_pylist()]
            doc, h, count = shingles(texts)
            key = _band_keys(doc, h, count, len(texts))
            repeats = np.bincount(doc[count > 1], minlength=len(texts)) > 0
            pick = repeats[doc]
            plain = key.copy()
            plain[repeats] = _band_keys((np.cumsum(repeats) - 1)[doc[pick]], h[pick], np.ones(int(pick.sum()), dtype=np.int64), int(repeats.sum()))
            some = np.bincount(doc, minlength=len(texts)) > 0
            own = np.concatenate([np.broadcast_to(some[:, None], key.shape), plain != key], axis=1)
            at = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([key, plain], axis=1)[own].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_words_digest(t) for t in texts], pa.binary()), keys], ["id", "words", "bands"])

    return slim.mapInArrow(run, f"id {kind}, words binary, bands array<bigint>")


def _packed(df: DataFrame) -> DataFrame:
    """(id, n, set binary): n sorted shingle hashes, then their counts if any is above one, eight bytes each."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", PASS_BYTES):
            doc, h, count = shingles([t or "" for t in b.column(1).to_pylist()])
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sets = [h[x:y].tobytes() + (count[x:y].astype(np.uint64).tobytes() if (count[x:y] > 1).any() else b"") for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sets, pa.binary())], ["id", "n", "set"])

    return df.mapInArrow(run, f"id {kind}, n long, set binary")


def _unpacked(n: int, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data.as_buffer(), dtype=np.uint64)
    return both[:n], both[n:] if len(both) > n else np.ones(n, dtype=np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that are similar enough."""
    kind = pairs.schema["u"].dataType.simpleString()
    side = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias("n" + k), F.col("set").alias("s" + k))
    joined = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "nu", "nv", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [max(similarity(*_unpacked(i, x), *_unpacked(j, y))) >= threshold for i, j, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, f"u {kind}, v {kind}")


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of ids whose texts (id, text) are similar enough."""
    began = mark()
    pairs = written(pairs, "pairs")
    needed = written(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "needed")
    # Rows that repeat an id with other texts stand for it each; any of them may link it.
    sets = written(_packed(texts.join(needed, "id", "left_semi")), "sets")
    found = written(_verified(pairs, sets, threshold), "found")
    cleared(texts.sparkSession, began)
    return found


def _rest_pairs(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (u, v) between components for documents (id, c), exact for either similarity.

    Shingles are ordered from rare to common among these documents. Similar sets share a shingle near the front of
    both: within the first share 1 - t of the larger one, and the first share (1 - t) / (1 + t) of the smaller one.
    What is common to a whole group stands at the end, so a large group makes few candidates.

    The same holds for probability Jaccard with shares of the summed counts. Let x and y be the shares that stand from
    the first common shingle on. A common shingle with shares p and q has the term 1 / sum max(p_j / p, q_j / q), and the
    sum is at least (1 - x) / p + 1 / q. That bound is concave and of degree one in (p, q), so all terms come to at most
    1 / (1 / x + 1 / y - 1). To reach t, 1 / x + 1 / y must be at most 1 + 1 / t: both shares are t at least, one of them
    2 t / (1 + t).
    """
    kind = rest.schema["id"].dataType.simpleString()
    own = written(texts.join(rest.select("id"), "id", "left_semi").repartition("id"), "rest-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for b in chunks(batches, "text", PASS_BYTES):
            h = shingles([t or "" for t in b.column(1).to_pylist()])[1]
            total += np.bincount((h >> CELL_SHIFT).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(total)
        for k in range(0, len(cell), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + 10_000]), pa.array(total[cell[k : k + 10_000]])], ["cell", "n"])

    # Document frequencies, hashed to CELLS cells, so what reaches the driver is bounded. Collisions only blur the order,
    # which any one order of all shingles may take.
    often = np.ones(CELLS, dtype=np.int32)
    for cell, n in own.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
        often[cell] = min(n, 2**31 - 1)
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", PASS_BYTES):
            doc, h, count = shingles([t or "" for t in b.column(1).to_pylist()])
            df = shared.value[(h >> CELL_SHIFT).astype(np.int64)]
            order = np.lexsort((h, df, doc))
            doc, h, df, count = doc[order], h[order], df[order], count[order]
            sizes = np.bincount(doc, minlength=b.num_rows)
            size, pos = sizes[doc], np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
            total = np.bincount(doc, weights=count, minlength=b.num_rows)
            before = np.cumsum(count) - count
            share = 1 - (before - before[(np.cumsum(sizes) - sizes)[doc]]) / total[doc]
            front = np.flatnonzero(((pos < size - np.ceil(size * threshold - 1e-9) + 1) | (share >= threshold - 1e-9)) & (df > 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[front])), pa.array(h[front].view(np.int64)), pa.array(size[front]), pa.array(pos[front]), pa.array(share[front]), pa.array((total > sizes)[doc[front]])], ["id", "token", "n", "pos", "share", "repeats"])

    columns = ("id", "c", "n", "pos", "share", "repeats")
    front = own.mapInArrow(fronts, f"id {kind}, token long, n long, pos long, share double, repeats boolean").join(rest, "id")
    front = written(front.select("token", *columns), "front")
    least = 2 * threshold / (1 + threshold)
    first = F.col("pos") < F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    small = front.where(first | (F.col("share") >= least - 1e-9)).select("token", *(F.col(k).alias(k + "1") for k in columns))
    large = front.select("token", *(F.col(k).alias(k + "2") for k in columns))
    # Of two that come equal in it, either may stand for the smaller one: the one of the lesser id does.
    ahead = lambda less, equal: less | (equal & (F.col("id1") < F.col("id2")))
    order = ahead(F.col("n1") < F.col("n2"), F.col("n1") == F.col("n2"))
    overlap = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= (F.col("n1") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-9
    plain = order & (F.col("n1") >= F.col("n2") * threshold - 1e-9) & overlap
    # Without repeats on either side the two similarities are equal, and the first bound is the closer one.
    counted = (F.col("repeats1") | F.col("repeats2")) & ahead(F.col("share1") > F.col("share2"), F.col("share1") == F.col("share2")) & (1 / F.col("share1") + 1 / F.col("share2") <= 1 + 1 / threshold + 1e-9)
    pairs = small.join(large, (small["token"] == large["token"]) & (F.col("c1") != F.col("c2")) & (plain | counted))
    return pairs.select(F.least("id1", "id2").alias("u"), F.greatest("id1", "id2").alias("v")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, words_id, component, kept): the least id with equal words, the least id of the class, and whether it is this one."""
    spark = df.sparkSession
    base = written(bands(df, id_col, text_col), "bands")
    copies = written(base.where("words IS NOT NULL AND id IS NOT NULL").groupBy("words").agg(F.min("id").alias("words_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    owned = base.join(copies, "words", "left").select("id", F.coalesce("words_id", "id").alias("words_id"), "bands")
    owned = written(owned, "owned")
    single = owned.where("words_id = id AND size(bands) > 0")
    keyed = single.select("id", F.explode("bands").alias("key"))
    texts = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    leaders = [F.min_by("id", F.xxhash64("id", "key", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), *leaders).where("n > 1"), "buckets")
    members = written(keyed.join(buckets, "key"), "members")
    ties = members.select(F.explode(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("l"), "id").where("l <> id").select(F.least("l", "id").alias("u"), F.greatest("l", "id").alias("v"))
    links = _linked(ties.distinct(), texts, threshold)
    found = components(links)
    side = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    split = written(side.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "split")
    rest = written(members.select("key", "id").join(split, "key", "left_semi").select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("c")), "rest")
    if not rest.isEmpty():
        more = _linked(_rest_pairs(rest, texts, threshold), texts, threshold)
        found = components(written(links.unionByName(more), "links"))
    component = F.coalesce("component", "words_id")
    out = owned.select("id", "words_id").join(found.select(F.col("id").alias("words_id"), "component"), "words_id", "left")
    return out.select("id", "words_id", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
