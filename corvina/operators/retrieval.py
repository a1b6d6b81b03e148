"""Vector search, keyword search, fusion and recall."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C
from corvina.functions.stemming import Analysis, stem_words
from corvina.sources.tables import written

RRF_K = 60
K1, B = 1.2, 0.75


def knn(points: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest points of one query vector, with score, ties by id. The scan is a top-k, no sort of all rows."""
    rows = points.where(where) if where is not None else points
    return rows.withColumn("score", C.similarity(query, metric)(F.col("vector"))).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


#: Query vectors that one pass carries to every task.
MOST_QUERIES = 4096


#: Scores that one matrix product of a task holds.
MOST_SCORES = 1 << 20


def query_blocks(queries: DataFrame, most: int | None = None):
    """The queries (query_id, query) in blocks of (ids, vectors); the driver holds one block at a time."""
    import numpy as np

    most = most or MOST_QUERIES
    held = []
    for r in queries.select("query_id", "query").where("query IS NOT NULL").toLocalIterator(prefetchPartitions=True):
        held.append((r[0], np.asarray(r[1], dtype=np.float64)))
        if len(held) == most:
            yield [i for i, _ in held], np.stack([v for _, v in held])
            held = []
    if held:
        yield [i for i, _ in held], np.stack([v for _, v in held])


def _unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Nearest:
    """The k nearest rows of each query of a block among those that a task was given, ties by id.

    Rows are sifted by products of at most MOST_SCORES scores. What is near enough is scored anew, component by component,
    so that equal vectors have equal scores whichever rows stand beside them.
    """

    SLACK = 1e-9

    def __init__(self, ids: list, q, k: int):
        import numpy as np
        import pyarrow as pa

        self.ids, self.q, self.unit, self.k = ids, q, _unit(q), k
        self.cut = np.full(len(ids), -np.inf)  # a score that k rows of the query have
        self.held, self.new, self.many = None, [], 0  # tables (col, score, id)
        self.names, self.pa = ["col", "score", "id"], pa

    def add(self, x, row_ids, cols=None):
        """Rows (vectors, Arrow ids) for all queries, or for those at some places."""
        import numpy as np

        n, unit = len(self.ids) if cols is None else len(cols), _unit(x)
        step = max(1, MOST_SCORES // max(n, 1))
        for lo in range(0, len(x), step):
            q, cut = (self.unit, self.cut) if cols is None else (self.unit[cols], self.cut[cols])
            s = q @ unit[lo : lo + step].T
            s[np.isnan(s)] = -np.inf
            if np.isneginf(cut).any() and s.shape[1] > self.k:
                cut = np.maximum(cut, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            col, row = np.nonzero((s >= cut[:, None] - self.SLACK) & (s > -np.inf))
            if len(col):
                col, row = (col if cols is None else cols[col]), row + lo
                self.new.append(self.pa.table([self.pa.array(col), self.pa.array(self._scores(x, row, col)), row_ids.take(self.pa.array(row))], self.names))
                self.many += len(col)
                if self.many > self.k * len(self.ids):
                    self._merge()

    def _scores(self, x, row, col):
        import numpy as np

        out = np.empty(len(row))
        for lo in range(0, len(row), 1 << 16):
            a, b = x[row[lo : lo + (1 << 16)]], self.q[col[lo : lo + (1 << 16)]]
            dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
            for j in range(x.shape[1]):
                dot, aa, bb = dot + a[:, j] * b[:, j], aa + a[:, j] * a[:, j], bb + b[:, j] * b[:, j]
            norm = np.sqrt(aa * bb)
            out[lo : lo + len(a)] = np.clip(np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), 0.0), -1.0, 1.0)
        return out

    def _merge(self):
        import numpy as np

        every = self.pa.concat_tables([*([self.held] if self.held is not None else []), *self.new])
        every = every.sort_by([("col", "ascending"), ("score", "descending"), ("id", "ascending")])
        col = every.column("col").to_numpy()
        first = np.flatnonzero(np.diff(col, prepend=-1))
        place = np.arange(len(col)) - np.repeat(first, np.diff(first, append=len(col)))
        full = place == self.k - 1
        self.cut[col[full]] = every.column("score").to_numpy()[full]
        self.held, self.new, self.many = every.filter(self.pa.array(place < self.k)).combine_chunks(), [], 0

    def batches(self):
        """What was found, as Arrow batches (query_id, id, score)."""
        if self.new:
            self._merge()
        if self.held is not None:
            asked = self.pa.array([self.ids[c] for c in self.held.column("col").to_pylist()])
            yield from self.pa.table([asked, self.held.column("id"), self.held.column("score")], ["query_id", "id", "score"]).to_batches(max_chunksize=10_000)


def knn_join(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest points of each query (query_id, query), with score and rank, ties by id.

    Queries are taken in blocks of MOST_QUERIES, one pass over the points for each. A task holds MOST_SCORES scores at a
    time and the k best rows of every query of the block, and only these leave it.
    """
    import numpy as np

    spark = points.sparkSession
    kind, qkind = points.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    slim = points.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = []

    def one_pass(shared):
        def run(batches):
            near = _Nearest(*shared.value, k)
            for whole in batches:
                for lo in range(0, whole.num_rows, 4096):
                    b = whole.slice(lo, 4096)
                    near.add(np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1), b.column(0))
            yield from near.batches()

        return slim.mapInArrow(run, f"query_id {qkind}, id {kind}, score double").withColumn("rank", rank).where(F.col("rank") <= k)

    for block in query_blocks(queries):
        found.append(one_pass(spark.sparkContext.broadcast(block)))
        if len(found) > 1:  # a later block: what an earlier one found is kept as a table, so that plans stay small
            found[-2] = written(found[-2], "knn")
    if not found:
        return spark.createDataFrame([], f"query_id {qkind}, id {kind}, score double, rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: Vectors that an index is audited with, neighbours of each, and the share of them that must stand in the cells that a search reads.
AUDITED, AUDIT_K, AUDIT_SHARE = 256, 32, 0.93


@dataclass
class VectorIndex:
    """An approximate index: unit vectors filed by the nearest of a few centroids, of which a search reads the cells nearest to its query."""

    cells: DataFrame  # (cell, id, vector), partitioned by cell
    centroids: object  # numpy array
    metric: str = "cosine"
    places: object = None  # numpy array: for each neighbour (rank, cells nearer to the vector than the neighbour's) of the audited vectors

    def least(self, k: int) -> int:
        """Cells to read so that AUDIT_SHARE of the k nearest of the audited vectors, themselves left out, stand in them."""
        import numpy as np

        if self.places is None or not len(self.places):
            return 1
        asked = self.places[self.places[:, 0] <= max(k, 1), 1]
        return int(np.sort(asked)[max(math.ceil(AUDIT_SHARE * len(asked)) - 1, 0)]) + 1 if len(asked) else 1


def build_index(points: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 6, metric: str = "cosine") -> VectorIndex:
    """File all points (id, vector) by centroids that are fitted on at most `sample` of them.

    Then the exact neighbours of AUDITED vectors, others than those where there are more, are looked up among all points:
    the cells that they stand in tell how many cells a search must read. A search that asks for another metric than the index was built for is refused. Without `cells` their number is the
    root of the number of points, 1024 at most.
    """
    import numpy as np
    import pyarrow as pa

    valid = points.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = valid.count()
    drawn = valid.orderBy(F.xxhash64("id")).limit(sample + AUDITED).collect()
    x = _unit(np.array([r["vector"] for r in drawn], dtype=np.float64).reshape(len(drawn), -1)) if drawn else np.zeros((0, 0))
    audited, x = x[-AUDITED:], x[:sample]
    many = max(1, min(cells or int(n**0.5), 1024, max(len(x), 1)))
    centroids = x[np.random.default_rng(7).choice(len(x), many, replace=False)] if len(x) else np.zeros((1, 0))
    for _ in range(rounds if len(x) else 0):
        near = (x @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.maximum(norm, 1e-300), centroids)
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    kind = valid.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array((v @ shared.value.T).argmax(axis=1).astype(np.int32)), b.column(0), b.column(1)], ["cell", "id", "vector"])

    filed = valid.mapInArrow(run, f"cell int, id {kind}, vector array<double>")
    index = VectorIndex(written(filed.repartitionByRange("cell", "id").sortWithinPartitions("cell"), "index"), centroids, metric)
    index.places = _places(index, audited)
    return index


def _places(index: VectorIndex, audited):
    """For each of the AUDIT_K nearest rows of each vector, itself left out, its rank and how many cells are nearer to the vector than the row's."""
    import numpy as np

    spark = index.cells.sparkSession
    asked = spark.createDataFrame([(n, v) for n, v in enumerate(audited.tolist())], "query_id long, query array<double>")
    found = knn_join(index.cells.select(F.col("cell").alias("id"), "vector"), asked, AUDIT_K + 1).where("rank > 1").collect()
    if not found:
        return None
    order = np.argsort(-(audited @ index.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    return np.array([(r["rank"] - 1, place[r["query_id"], r["id"]]) for r in found])


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): the k nearest, by exact cosine, among the points of the cells nearest to each query.

    `probes` cells are read at least, more where the index's audit asks for more: what lies near to a vector is spread over
    the more cells, the more of them there are.
    """
    import numpy as np
    import pyarrow as pa

    if metric != index.metric:
        raise ValueError(f"the index orders by {index.metric}, not by {metric}")
    spark, cells = index.cells.sparkSession, index.cells
    kind, qkind = cells.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = spark.createDataFrame([], f"query_id {qkind}, id {kind}, score double, rank int")
    probes = max(probes, index.least(k))
    for ids, q in query_blocks(queries):
        near = np.argsort(-(_unit(q) @ index.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        shared = spark.sparkContext.broadcast((ids, q, near))

        def run(batches, shared=shared):
            ids, q, near = shared.value
            best = _Nearest(ids, q, k)
            asking = np.argsort(near.ravel(), kind="stable")  # the queries of a cell lie together
            ends = np.searchsorted(near.ravel()[asking], np.arange(near.max(initial=0) + 2))
            for whole in batches:
                for lo in range(0, whole.num_rows, 4096):
                    b = whole.slice(lo, 4096)
                    cell = b.column(0).to_numpy()
                    x = np.asarray(b.column(2).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                    for c in np.unique(cell):
                        asks, rows = asking[ends[c] : ends[c + 1]] // near.shape[1], np.flatnonzero(cell == c)
                        if len(asks):
                            best.add(x[rows], b.column(1).take(pa.array(rows)), asks)
            yield from best.batches()

        wanted = cells.where(F.col("cell").isin(*map(int, np.unique(near))))
        hits = wanted.mapInArrow(run, f"query_id {qkind}, id {kind}, score double").withColumn("rank", rank).where(F.col("rank") <= k)
        out = out.unionByName(written(hits, "probed"))
    return out


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted): how many of the exact neighbours of each query were found."""
    mine = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(mine, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    return sorted(set("".join(c if "a" <= c <= "z" else " " for c in query.lower()).split()))


def _runs(ordered: Column, key) -> Column:
    """(at, n) of each run of elements with the same key in an array that is ordered by it."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))))
    return C.bound(starts, lambda s: F.transform(s, lambda at, k: F.struct(at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(ordered)) - at).alias("n"))))


def _counted(docs: DataFrame, analysis: Analysis) -> DataFrame:
    """(id, length, terms) of a table (id, text): the terms (term, tf) of each text, counted in its row."""
    words = F.filter(F.split(analysis.text(F.col("text")), "[^a-z]+"), lambda x: (x != "") & ~x.isin(*analysis.stop_words) if analysis.stop_words else x != "")
    rows = docs.select("id", words.alias("w"))
    if analysis.stem:
        rows = rows.select("id", stem_words("w").alias("w"))
    counts = lambda w: F.transform(_runs(w, lambda x: x), lambda r: F.struct(F.get(w, r["at"]).alias("term"), r["n"].cast("long").alias("tf")))
    return rows.select("id", F.size("w").alias("length"), C.bound(F.sort_array("w"), counts).alias("terms"))


def postings(docs: DataFrame, analysis: Analysis = Analysis()) -> DataFrame:
    """(id, term, tf, length) of a table (id, text), without a shuffle; length counts the terms that are left of a text."""
    return _counted(docs, analysis).select("id", "length", F.explode("terms").alias("x")).select("id", "length", "x.term", "x.tf")


#: Files of terms that a keyword index is parted into; a query reads those of its terms.
TERM_PARTS = 64


@dataclass
class KeywordIndex:
    """Postings by term and the figures of the corpus, written once; `bm25_indexed` reads only the parts of its terms."""

    postings: DataFrame  # (part, term, id, tf, length)
    documents: int
    average: float
    analysis: Analysis = Analysis()


#: Term parts that travel together to the task that writes them, and postings that such a task gets, about.
PARTS_A_TASK, TASK_POSTINGS = 8, 1_000_000


def build_keyword_index(docs: DataFrame, analysis: Analysis = Analysis()) -> KeywordIndex:
    """Index a table (id, text). An index stands for one snapshot: after rows went or came it is built anew.

    The terms of a text travel as one string for each group of term parts, to tasks that are as many as the texts ask for.
    """
    part = lambda term: F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")
    # Documents without a word have no posting but count. A posting takes 8 bytes of a text at least, about.
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = TERM_PARTS // PARTS_A_TASK
    salts = max(8, -(-(size["bytes"] or 0) // (8 * TASK_POSTINGS * groups)))
    grouped = F.sort_array(F.transform("terms", lambda x: F.struct(F.floor(part(x["term"]) / PARTS_A_TASK).cast("int").alias("g"), x["term"].alias("term"), x["tf"].alias("tf"))))
    strings = lambda x: F.struct(x[0]["g"].alias("g"), F.array_join(F.transform(x, lambda y: y["term"]), " ").alias("terms"), F.array_join(F.transform(x, lambda y: y["tf"].cast("string")), " ").alias("times"))
    slices = lambda t: F.transform(_runs(t, lambda x: x["g"]), lambda r: C.bound(F.slice(t, r["at"] + 1, r["n"]), strings))
    rows = _counted(docs, analysis).select("id", "length", F.explode(C.bound(grouped, slices)).alias("x")).select("id", "length", "x.*")
    rows = rows.repartition(groups * salts, "g", F.pmod(F.xxhash64("id"), F.lit(salts)))
    pairs = F.arrays_zip(F.split("terms", " ").alias("term"), F.split("times", " ").alias("tf"))
    rows = rows.select("id", "length", F.explode(pairs).alias("x")).select("id", "length", "x.term", F.col("x.tf").cast("long").alias("tf"))
    kept = written(rows.withColumn("part", part("term")).sortWithinPartitions("part", "term"), "postings", "part")
    total = kept.agg(F.sum("tf").alias("t")).first()["t"] or 0
    return KeywordIndex(kept, size["n"], total / size["n"] if size["n"] else 0.0, analysis)


def bm25_indexed(index: KeywordIndex, query: str, k: int | None = None) -> DataFrame:
    """(id, score), as bm25 gives, from the postings of the query's terms alone."""
    terms = index.analysis.terms(query)
    spark = index.postings.sparkSession
    part = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int").alias("p"))
    parts = [r["p"] for r in part.distinct().collect()]
    rows = index.postings.where(F.col("part").isin(*parts) & F.col("term").isin(*terms)) if terms else index.postings.limit(0)
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    n, tf = F.lit(float(index.documents)), F.col("tf")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.average or 1.0)))
    # One row for each term of the query: bounded by the query.
    found = rows.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(score).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k) if k else found


def bm25(docs: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """(id, score) of a table (id, text), in one pass over the texts: lengths and counts go to a small table that the scores read."""
    terms = query_terms(query)
    low = F.lower("text")
    hits = F.regexp_extract_all(low, F.lit("(?<![a-z])(?:" + "|".join(terms or ["0"]) + ")(?![a-z])"), F.lit(0))
    times = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = docs.select("id", F.coalesce(F.regexp_count(low, F.lit("[a-z]+")), F.lit(0)).alias("length"), F.coalesce(hits, F.array().cast("array<string>")).alias("w"))
    rows = written(rows.select("id", "length", *(times(t).alias(f"t{i}") for i, t in enumerate(terms))), "counts")
    # Lengths of all documents, document frequencies of the terms: one row.
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"t{i}") > 0)
    joined = rows.where(some).crossJoin(F.broadcast(stats)) if terms else rows.crossJoin(stats).limit(0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg")))).otherwise(0.0)
    found = joined.select("id", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(k) if k else found


def ranked(hits: DataFrame, position: int) -> DataFrame:
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.lit(position).alias("list"))


def rrf(lists: list[DataFrame], limit: int | None = None, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of top-k lists (key, score): (key, score, list), ties by key. The lists are short by their limits."""
    lists = [hits.withColumnRenamed(key, "id") for hits in lists] if key != "id" else lists
    every = None
    for i, hits in enumerate(lists):
        one = ranked(hits, i)
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("id").agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("score"), F.min("list").alias("list"))
    out = fused.orderBy(F.desc("score"), "id")
    return (out.limit(limit) if limit else out).withColumnRenamed("id", key)


def pool_size(limit: int, reranker_pool: int | None = None) -> int:
    return max(limit, max(reranker_pool, 20) if reranker_pool else 20)


def search(points: DataFrame, mode: str, text: str, vector: list[float] | None, limit: int = 10, where: Column | None = None) -> DataFrame:
    """Vector, keyword or hybrid search; hybrid fuses two pools by rank. Keyword scores are corpus-wide, filters follow."""
    pool = pool_size(limit)
    kept = points.where(where) if where is not None else points
    if mode == "vector":
        return knn(points, vector, limit, where=where).select("id", "score", F.lit("cosine").alias("score_kind"))
    words = bm25(points.select("id", "text"), text)
    if where is not None:
        words = words.join(kept.select("id"), "id", "left_semi")
    words = words.orderBy(F.desc("score"), "id").limit(pool if mode == "hybrid" else limit)
    if mode == "keyword":
        return words.select("id", "score", F.lit("bm25").alias("score_kind"))
    near = knn(points, vector, pool, where=where).select("id", "score")
    return rrf([near, words], limit).select("id", "score", F.lit("rrf").alias("score_kind"))


def recall(points: DataFrame, memories: DataFrame, query: list[float], limit: int, project: str | None = None, before: bool = False) -> DataFrame:
    """Memories by the blend of their best intro and best body scores; live rows and the project are filtered after.

    So fewer than `limit` may be left. With `before` the filters come first and that cannot happen.
    """
    base = F.when(F.col("level") == "memory_chunk", C.base_memory_id(F.col("id"))).otherwise(F.col("id"))
    if before:
        allowed = memories.where("deleted_at IS NULL")
        allowed = allowed.where(F.col("project") == project) if project else allowed
        points = points.withColumn("__base", base).join(allowed.select(F.col("id").alias("__base")), "__base", "left_semi").drop("__base")
    near = knn(points, query, max(8 * limit, 40), where=F.col("level").isin("memory", "memory_chunk"))
    best = near.groupBy(base.alias("id")).agg(F.max(F.when(F.col("level") == "memory", F.col("score"))).alias("intro"), F.max(F.when(F.col("level") == "memory_chunk", F.col("score"))).alias("body"))
    rows = best.withColumn("score", C.blend(F.col("intro"), F.col("body"))).join(memories, "id").where("deleted_at IS NULL")
    rows = rows.where(F.col("project") == project) if project else rows
    return rows.orderBy(F.desc("score"), "id").limit(limit)
