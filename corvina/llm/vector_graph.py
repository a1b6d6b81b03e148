"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping shards: two k-means partitions, in each the OVERLAP nearest centroids, and apart by
label. Each label has as many centroids as its own number of vectors asks for, so a hot label has more shards, not larger
ones, and beyond CENTROIDS shards are divided once more by the nearest centroids of the other partition. In a shard every vector gets a pool of its nearest members, which robust pruning thins: a candidate goes when
an already chosen neighbour is nearer to it by the factor ALPHA. A few random neighbours join it, and of those that chose
it the BACK nearest, so its list is bounded. The adjacency lists of a vector are united over its
shards. Then every vector searches each of its shards: greedy search from the medoids keeps a beam of the best, and
whatever lies in range is expanded until nothing in range is left. A sample of the queries of each shard is compared
with all members; if any link was missed, the shard is searched again with a wider beam. Every link is verified by its
cosine in double precision.

Links are counted where they are found: a pair that shares several shards counts in the first of them only, so no pair
leaves a task, however dense a group is. Each shard passes on a forest of its links, and the classes are the components
of these. A shard over MOST members is searched in pairs of blocks, so a task never holds more than MOST rows.

At last the whole is audited: AUDIT vectors, drawn by a hash, are compared with all vectors of their labels in one scan.
If less than LEAST_RECALL of their links were found, all is dealt again with twice the overlap.

Equal vectors of a label form a class, represented by its least id and weighted by its size; one of each class is
dealt, so however often a vector is repeated, it is one row of a shard.

Cases: vectors that are null, empty or zero, or hold null or non-finite parts, and rows with a null label link with
nothing. Rows that repeat an id count as one vector, the first in a fixed order. Equal vectors link. Vectors of another
length are another space; centroids are fitted for the WIDTHS commonest lengths, vectors of other lengths share one
shard for each label. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import written
from corvina.llm.components import components

THRESHOLD = 0.93
#: Members of a shard that are aimed at, and at most.
AIM, MOST = 400, 4096
PARTITIONS, OVERLAP, MOST_OVERLAP = 2, 2, 16
#: Bounds of the k-means fit: vectors in the sample, their components in all, centroids, lengths of vectors.
SAMPLE, SAMPLE_VALUES, CENTROIDS, WIDTHS = 16_384, 1 << 23, 4096, 4
DEGREE, FAR, BACK, POOL, ALPHA, BEAM, MEDOIDS = 16, 3, 16, 48, 1.2, 24, 4
#: Queries of a shard that are compared with all members; vectors of the last audit, and the share of links it asks for.
SHARD_AUDIT, AUDIT, LEAST_RECALL = 24, 512, 0.95


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids, in single precision; products are taken in blocks of rows."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds if k > 1 else 0):
        near = np.concatenate([(x[a : a + 2048] @ c.T).argmax(axis=1) for a in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def robust_pruned(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA, far: int = FAR, back: int = BACK, seed: int = 0) -> list[np.ndarray]:
    """Neighbour numbers of each row: those that pruning leaves, `far` drawn at random as ways between groups, and of the rows that chose it the `back` nearest."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    x = x.astype(np.float32)
    chosen = np.full((n, degree), -1, dtype=np.int64)
    near = np.full((n, degree), -np.inf, dtype=np.float32)
    size = min(pool, n - 1)
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sim, size - 1, axis=1)[:, :size]
        order = np.argsort(-np.take_along_axis(sim, cand, axis=1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        dist = 1 - np.take_along_axis(sim, cand, axis=1)
        own = x[cand]
        between = 1 - np.matmul(own, own.transpose(0, 2, 1))
        alive = np.ones(cand.shape, dtype=bool)
        filled = np.zeros(len(rows), dtype=np.int64)
        q = np.arange(len(rows))
        while True:
            first = alive.argmax(axis=1)
            go = alive[q, first] & (filled < degree)
            if not go.any():
                break
            w = q[go]
            f = first[go]
            chosen[rows[w], filled[w]] = cand[w, f]
            near[rows[w], filled[w]] = 1 - dist[w, f]
            filled[w] += 1
            alive[w] &= alpha * between[w, f] > dist[w]
            alive[w, f] = False
    # Whoever chose a row is a way to it; the nearest of them join its list.
    source, slot = np.nonzero(chosen >= 0)
    target, close = chosen[source, slot], near[source, slot]
    order = np.lexsort((source, -close, target))
    target, source = target[order], source[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    target, source = target[place < back], source[place < back]
    drawn = np.random.default_rng(seed).integers(0, n, size=(n, far))
    rows = np.concatenate([np.repeat(np.arange(n), degree), target, np.repeat(np.arange(n), far)])
    to = np.concatenate([chosen.reshape(-1), source, drawn.reshape(-1)])
    edge = np.unique((rows * n + to)[(to >= 0) & (to != rows)])
    return np.split(edge % n, np.searchsorted(edge // n, np.arange(1, n)))


def search(product: np.ndarray, adjacency: tuple[np.ndarray, np.ndarray], starts: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Cosine of every query with each row it visited, -inf elsewhere.

    product: cosines of queries with all rows, of which only those are read that a query visits. adjacency: (first
    places, neighbour numbers).
    """
    q, n = product.shape
    first, near = adjacency
    degree = np.diff(first)
    seen = np.full((q, n), -np.inf, dtype=product.dtype)
    done = np.zeros((q, n), dtype=bool)
    seen[:, starts] = product[:, starts]

    def expand(rows: np.ndarray, nodes: np.ndarray) -> None:
        done[rows, nodes] = True
        for lo in range(0, len(rows), 50_000):
            r, m = rows[lo : lo + 50_000], nodes[lo : lo + 50_000]
            many = degree[m]
            at = np.repeat(first[m] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            a, b = np.repeat(r, many), near[at]
            seen[a, b] = product[a, b]

    live = np.arange(q)
    while len(live):
        # Greedy phase: one step for each query whose beam still holds a row that was not expanded.
        open_sim = np.where(done[live], -np.inf, seen[live])
        best = open_sim.argmax(axis=1)
        top = open_sim[np.arange(len(live)), best]
        limit = np.partition(seen[live], n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(live), -np.inf)
        go = (top > -np.inf) & (top >= limit)
        live, best = live[go], best[go]
        expand(live, best)
    while True:
        # Range phase: everything in range is expanded until nothing new comes into range.
        rows, nodes = np.nonzero((seen >= threshold) & ~done)
        if not len(rows):
            return seen
        expand(rows, nodes)


def links_in_shard(x: np.ndarray, adjacency: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, seed: int = 0) -> tuple[np.ndarray, float]:
    """A symmetric matrix of links between rows, and the recall that the audit of the last search found."""
    n = len(x)
    found = np.zeros((n, n), dtype=bool)
    if n < 2:
        return found, 1.0
    rng = np.random.default_rng(seed)
    # Medoids: the member nearest to the mean, then members far from those chosen.
    starts = [int((x @ x.mean(axis=0)).argmax())]
    far = x @ x[starts[0]]
    for _ in range(min(MEDOIDS, n) - 1):
        starts.append(int(far.argmin()))
        far = np.maximum(far, x @ x[starts[-1]])
    sample = rng.choice(n, size=min(SHARD_AUDIT, n), replace=False)
    truth = x[sample] @ x.T >= threshold
    truth[np.arange(len(sample)), sample] = False
    # The search goes by single precision; what comes near the threshold is verified in double.
    narrow, slack = x.astype(np.float32), 1e-5
    beam, recall = BEAM, 0.0
    while True:
        for a in range(0, n, 512):
            rows = np.arange(a, min(n, a + 512))
            seen = search(narrow[rows] @ narrow.T, adjacency, np.array(sorted(set(starts))), threshold - slack, beam)
            u, v = np.nonzero(seen >= threshold - slack)
            for lo in range(0, len(u), 100_000):
                s, t = rows[u[lo : lo + 100_000]], v[lo : lo + 100_000]
                found[s, t] = np.einsum("ij,ij->i", x[s], x[t]) >= threshold
        found |= found.T
        found[np.arange(n), np.arange(n)] = False
        wanted = int(truth.sum())
        recall = float((found[sample] & truth).sum() / wanted) if wanted else 1.0
        if recall == 1.0 or beam >= n:
            return found, recall
        beam *= 4


def _forest(found: np.ndarray) -> np.ndarray:
    """The least row that each row reaches."""
    root = np.arange(len(found))
    u, v = np.nonzero(found)
    while len(u):
        low = root.copy()
        np.minimum.at(low, u, root[v])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at norm 1 in double precision, zero where they are zero or not finite; and which rows are not."""
    good = np.isfinite(x).all(axis=1)
    x = np.where(good[:, None], x, 0.0)
    most = np.abs(x).max(axis=1, initial=0)
    good &= most > 0
    x[good] /= most[good, None]
    x[good] /= np.linalg.norm(x[good], axis=1)[:, None]
    return x, good


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The parts of all lists in double precision, null as not a number."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(pc.fill_null(one.flatten().cast(pa.float64()), math.nan))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return scaled(_flat(column).reshape(len(column), -1))[0]


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, first) of all vectors, first being the least id of equal ones; (label, width, v, id, copies) of each class)."""
    # Floats stay floats on their way, at half the size; a task turns them into doubles.
    vec = df[vec_col] if df.schema[vec_col].dataType.simpleString() == "array<float>" else df[vec_col].cast("array<double>")
    # One row for an id: the first by label and vector.
    slim = df.select(df[id_col].alias("id"), df[label_col].cast("string").alias("label"), vec.alias("v"))
    rows = written(slim.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "vectors")
    there = "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
    valid = written(rows.where(there).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("width", F.size("v")), "classes")
    again = written(valid.where("copies > 1").select("label", "v", F.col("id").alias("first")), "repeated")
    return written(rows.join(again, ["label", "v"], "left").select("id", F.coalesce("first", "id").alias("first")), "firsts"), valid


def dealt(valid: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """A row for each shard, and pair of blocks in it, of each valid vector: (id, label, width, copies, shard, vec, shards, block, low, high)."""
    spark = valid.sparkSession
    # Beyond the centroids of one partition, a shard is divided once more, by the nearest centroids of the next one.
    top = round(math.log(CENTROIDS, 4))
    ratio = F.greatest(F.lit(1.0), F.col("n") * overlap / AIM)
    level = F.least(F.lit(2 * top), F.ceil(F.round(F.log(ratio) / math.log(4), 9))).cast("int")
    sizes = written(valid.groupBy("label", "width").agg(F.count("*").alias("n")).withColumn("level", level), "label-sizes")
    widths = sizes.groupBy("width").agg(F.sum("n").alias("n"), F.max("level").alias("level")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    centres: dict[int, list] = {}
    for w in widths:
        drawn = valid.where(F.col("width") == w["width"]).orderBy(F.xxhash64("id")).select("v").limit(min(SAMPLE, max(256, SAMPLE_VALUES // w["width"]))).toArrow()
        x, good = scaled(_flat(drawn.column("v")).reshape(drawn.num_rows, -1))
        x = x[good]
        if len(x):
            centres[w["width"]] = [[kmeans(x, 4**k, seed) for seed in range(PARTITIONS)] for k in range(min(top, w["level"]) + 1)]
    shared = spark.sparkContext.broadcast(centres)  # under 4/3 CENTROIDS vectors for each partition and length
    kind = valid.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                widths, levels, flat = b.column("width").to_numpy(), b.column("level").to_numpy(), _flat(b.column("v"))
                for width, level in sorted(set(zip(widths.tolist(), levels.tolist()))):
                    own = (widths == width) & (levels == level)
                    x, good = scaled(flat[np.repeat(own, widths)].reshape(-1, width))
                    fitted = shared.value.get(width)
                    near = [np.zeros((len(x), 1), dtype=np.int64)]
                    if fitted:
                        first, second = min(level, top), max(level - top, 0)
                        closest = lambda k, t: np.argsort(-(x.astype(np.float32) @ fitted[k][t].T), axis=1, kind="stable")[:, :overlap]  # noqa: E731, B023
                        near = [closest(first, t) + t * 4**first for t in range(PARTITIONS)]
                        if second:
                            near = [(c[:, :, None] * 4**second + closest(second, (t + 1) % PARTITIONS)[:, None, :]).reshape(len(x), -1) for t, c in enumerate(near)]
                    near = np.sort(np.concatenate(near, axis=1), axis=1)[good].astype(np.int32)
                    kept = b.take(pa.array(np.repeat(np.flatnonzero(own)[good], near.shape[1])))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(near.reshape(-1)), near.shape[1]).cast(pa.list_(pa.int32()))
                    lists = lists.take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([kept.column(k) for k in ("id", "label", "width", "copies")] + [pa.array(near.reshape(-1)), kept.column("v"), lists], ["id", "label", "width", "copies", "shard", "vec", "shards"])

    part = valid.schema["v"].dataType.simpleString()
    rows = valid.join(sizes.drop("n"), ["label", "width"]).select("id", "label", "width", "copies", "level", "v")
    rows = written(rows.mapInArrow(run, f"id {kind}, label string, width int, copies long, shard int, vec {part}, shards array<int>"), "dealt")
    # A shard that is too large is searched in pairs of blocks: each row goes to every pair its block is in.
    counts = rows.groupBy("label", "width", "shard").agg(F.count("*").alias("n")).withColumn("blocks", F.when(F.col("n") > MOST, F.ceil(F.col("n") * 2 / MOST)).otherwise(1).cast("int")).drop("n")
    cut = rows.join(written(counts, "counts"), ["label", "width", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return written(cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other"), "shards")


KEY = ["label", "width", "shard", "low", "high"]


def searched(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, n, copies, root, label, width, shard, recall) of the rows of all shards: the links counted there, and the least member reached."""
    kind = rows.schema["id"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        near = robust_pruned(_matrix(table.column("vec")))
        ids = table.column("id").combine_chunks()
        at = np.concatenate([[0], np.cumsum([len(r) for r in near])]).astype(np.int32)
        return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(at), ids.take(pa.array(np.concatenate(near) if len(near) else np.zeros(0, np.int64))))})

    lists = rows.groupBy(*KEY).applyInArrow(build, f"id {kind}, near array<{kind}>")
    # A vector is in a bounded number of shards and pairs of blocks, and its list in each is bounded.
    united = written(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    ready = rows.join(united, "id", "left")

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.column("id"))
        table = table.take(order)
        ids = table.column("id").combine_chunks()
        x, block, copies = _matrix(table.column("vec")), table.column("block").to_numpy(), table.column("copies").to_numpy()
        shards = np.asarray(table.column("shards").combine_chunks().flatten()).reshape(len(x), -1)
        lists = table.column("near").combine_chunks()
        many = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        place = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=ids), -1), dtype=np.int64)
        owner = np.repeat(np.arange(len(x)), many)[place >= 0]
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(x)))])
        shard, low, high = (table.column(c)[0].as_py() for c in ("shard", "low", "high"))
        found, recall = links_in_shard(x, (first, place[place >= 0]), threshold, seed=shard)
        if low != high:
            found &= block[:, None] != block[None, :]
        root = _forest(found)
        u, v = np.nonzero(found)
        own = np.zeros(len(x), dtype=np.int64)
        for lo in range(0, len(u), 200_000):
            s, t = u[lo : lo + 200_000], v[lo : lo + 200_000]
            # The first shard that both are in counts the link.
            common = np.where((shards[t][:, :, None] == shards[s][:, None, :]).any(axis=2), shards[t], np.iinfo(np.int32).max)
            np.add.at(own, s, np.where(common.min(axis=1) == shard, copies[t], 0))
        same = {k: pa.array([table.column(k)[0].as_py()] * len(x), pa.string() if k == "label" else pa.int32()) for k in ("label", "width", "shard")}
        return pa.table({"id": ids, "n": pa.array(own), "copies": pa.array(copies), "root": ids.take(pa.array(root)), **same, "recall": pa.array([recall] * len(x))})

    return written(ready.groupBy(*KEY).applyInArrow(run, f"id {kind}, n long, copies long, root {kind}, label string, width int, shard int, recall double"), "hits")


def audited(valid: DataFrame, hits: DataFrame, threshold: float = THRESHOLD, most: int = AUDIT) -> DataFrame:
    """(id, wanted, found) of at most `most` vectors drawn by a hash: their links among all vectors of their labels, and those that were counted."""
    drawn = valid.orderBy(F.xxhash64("id", F.lit("audit"))).limit(most).select("id", "label", "width", "copies", "v").toArrow().to_pylist()
    shared = valid.sparkSession.sparkContext.broadcast(drawn)  # bounded by `most`
    kind = valid.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[tuple, list] = {}
        for r in shared.value:
            spaces.setdefault((r["label"], r["width"]), []).append(r)
        queries = {k: ([r["id"] for r in v], scaled(np.array([[math.nan if y is None else y for y in r["v"]] for r in v], dtype=np.float64))) for k, v in spaces.items()}
        total = {k: np.zeros(len(v[0]), dtype=np.int64) for k, v in queries.items()}
        for b in batches:
            label, widths, copies, flat = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy(), _flat(b.column(3))
            space = {}
            for i, k in enumerate(zip(label, widths.tolist())):
                if k in queries:
                    space.setdefault(k, []).append(i)
            for k, rows in space.items():
                own = np.zeros(len(widths), dtype=bool)
                own[rows] = True
                x, good = scaled(flat[np.repeat(own, widths)].reshape(-1, k[1]))
                q, sound = queries[k][1]
                total[k] += ((x @ q.T >= threshold) & good[:, None] & sound[None, :]).T @ copies[own]
        ids = [i for k in queries for i in queries[k][0]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *total.values()]))], ["id", "n"])

    seen = valid.select("label", "width", "copies", "v").mapInArrow(run, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    chosen = valid.sparkSession.createDataFrame([(r["id"],) for r in drawn], f"id {kind}")
    counted = hits.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg((F.sum("n") + F.max("copies") - 1).alias("found"))
    # A vector reaches itself and its copies; itself is no link.
    return seen.join(counted, "id", "left").select("id", F.greatest(F.col("n") - 1, F.lit(0)).alias("wanted"), F.coalesce("found", F.lit(0)).alias("found"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((id, n_links, component, kept) for each vector, the last audit (id, wanted, found))."""
    base, valid = classes(df, id_col, vec_col, label_col)
    overlap = OVERLAP
    while True:
        hits = searched(dealt(valid, overlap), threshold)
        audit = written(audited(valid, hits, threshold), "audit")
        told = audit.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("w"), F.coalesce(F.sum("found"), F.lit(0)).alias("f")).first()
        if told["f"] >= LEAST_RECALL * told["w"] or overlap >= MOST_OVERLAP:
            break
        overlap *= 2
    counts = hits.groupBy(F.col("id").alias("first")).agg((F.sum("n") + F.max("copies") - 1).alias("n_links"))
    reached = components(hits.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "first")
    out = base.join(counts, "first", "left").join(reached, "first", "left")
    # A class without a count has no shard, as its vector is not a valid one.
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.coalesce("component", "first"))
    done = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return done, audit
