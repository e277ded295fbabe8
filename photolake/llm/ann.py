"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, and posted under each
of them in pivot inverted files. A query walks the lists of its own nearest
pivots, which gives the footrule distance between the two orders for the rows
met there; the rows of least distance are reranked by exact inner product.

Rows live in the cell of their nearest pivot. Neighbouring cells make up a
bundle of about ROW_BLOCK rows, a larger cell is dealt into parts of that size,
and each part has its inverted files to itself. A query goes only to bundles
that hold a cell near it. How many cells that takes, what share of the rows
there has to be reranked, and what cosine a footrule distance stands for, is
learnt on a bounded sample. Rows longer than nearly all of the sample can be
near to any query, and have a bundle that every query visits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.session import drop_stash, stash, table, use_package

NEIGHBOURS = 20
#: Documented bounds: pivots are centres of the rows of smallest hashed ids.
PIVOTS, PIVOT_SAMPLE = 1024, 4096
#: Pivots under which a row is posted, and lists that a query walks.
LISTED, WALKED = 64, 48
#: Shares of the sample's neighbours that the visited cells must hold, and that must be reranked there.
REACHED, FOUND = 0.995, 0.95
ROW_BLOCK, QUERY_BLOCK = 8192, 16384


def usable(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id whose vector is neither null, zero nor holds null or non-finite components."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    good = good.filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists if isinstance(lists, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = x @ pivots.T
    prefix = min(prefix, near.shape[1])
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(prefix), (len(x), 1))
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


class InvertedFiles:
    """Under each pivot the rows that name it among their nearest, with the place they give it."""

    def __init__(self, order: np.ndarray, pivots: int):
        rows, self.listed = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = rows
        self.row = np.repeat(np.arange(rows, dtype=np.int32), self.listed)[by_pivot]
        self.place = np.tile(np.arange(self.listed, dtype=np.int32), rows)[by_pivot]
        self.start = np.searchsorted(flat[by_pivot], np.arange(pivots + 1)).tolist()

    def agreement(self, asked: list[int]) -> np.ndarray:
        """The footrule distance of every row's order to the query's, turned over: 0 for rows that share no list, more for nearer ones."""
        spans = [slice(self.start[p], self.start[p + 1]) for p in asked]
        place = np.concatenate([self.place[x] for x in spans])
        place -= np.repeat(np.arange(len(asked), dtype=np.int32), [x.stop - x.start for x in spans])
        np.abs(place, out=place)
        return np.bincount(np.concatenate([self.row[x] for x in spans]), self.listed - place, self.rows)


@dataclass
class Fit:
    """What the sample tells: pivots, cosine a + b * agreement (a raised by three standard deviations), cells a query visits, the length from which rows are kept apart, and the share of a visited part's rows that a query reranks."""

    pivots: np.ndarray
    a: float
    b: float
    probes: int
    long: float
    share: float


def fit(x: np.ndarray, pivots: int = PIVOTS, listed: int = LISTED, walked: int = WALKED, rounds: int = 5, k: int = NEIGHBOURS) -> Fit:
    """Pivots by spherical k-means, at most one for four vectors of the sample.

    The neighbours that a query has in the sample are farther than those it has
    in the whole table, so what suffices to find them suffices there.
    """
    size = _lengths(x)
    unit = x / size[:, None]
    centre = unit[: max(1, min(pivots, len(unit) // 4))].copy()
    for _ in range(rounds):
        near = (unit @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, unit)
        length = _lengths(sums)
        centre[length > 1e-12] = sums[length > 1e-12] / length[length > 1e-12, None]
    asked = np.arange(0, len(x), max(1, len(x) // 128))
    files = InvertedFiles(permutations(unit, centre, listed), len(centre))
    order = np.argsort(-(unit[asked] @ centre.T), axis=1, kind="stable")
    agree = np.stack([files.agreement(o[:walked].tolist()) for o in order])
    cosine = unit[asked] @ unit.T
    other = np.arange(len(x))[None, :] != asked[:, None]
    b, a = np.polyfit(agree[other], cosine[other], 1) if other.sum() > 1 and np.ptp(agree[other]) else (1.0, 0.0)
    spread = float((cosine[other] - a - b * agree[other]).std()) if other.any() else 0.0
    # How far down a query's order of pivots the cells of its neighbours come, neighbours being its nearest hundredth of the sample.
    score = np.where(other, x[asked] @ x.T, -np.inf)
    nearest = np.argsort(-score, axis=1, kind="stable")[:, : max(1, len(x) // 100)]
    cell = (unit @ centre.T).argmax(axis=1)
    place = np.argsort(order, axis=1)
    reach = np.take_along_axis(place, cell[nearest], axis=1)
    a, b = float(a + 3 * spread), float(max(b, 1e-12))
    probes = int(np.quantile(reach, REACHED, method="higher")) + 1
    # How far down the order of a query's visited rows its k nearest come, as a share of these.
    long = float(np.quantile(size, 0.99)) * 1.000001
    worth = np.where(other & (place[:, cell] < probes) & (size <= long), size * (a + b * agree), -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(len(x) - 1, 1))]
    mine = np.take_along_axis(worth, best, axis=1)
    ahead = np.stack([(w[None, :] > m[:, None]).sum(axis=1) for w, m in zip(worth, mine, strict=True)])
    shares = (ahead / np.maximum(np.isfinite(worth).sum(axis=1, keepdims=True), 1))[np.isfinite(mine)]
    share = float(np.quantile(shares, FOUND, method="higher")) if len(shares) else 1.0
    return Fit(centre, a, b, probes, long, share)


def bundle_cells(pivots: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The bundle of each cell: cells are halved along their main direction until a bundle holds at most `most` rows or is one cell."""
    out, n = np.zeros(len(pivots), np.int64), 0
    todo = [np.arange(len(pivots))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or rows[own].sum() <= most:
            out[own], n = n, n + 1
            continue
        centred = pivots[own] - pivots[own].mean(axis=0)
        along = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
        own = own[along]
        half = int(np.searchsorted(np.cumsum(rows[own]), rows[own].sum() / 2)) + 1
        half = min(max(half, 1), len(own) - 1)
        todo += [own[:half], own[half:]]
    return out


def search_part(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, f: Fit, k: int, listed: int = LISTED, walked: int = WALKED, share: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of a part for each query: (query index, row index, score). Rows must be in order of their ids, so that ties fall alike in every run.

    Rows rank by the cosine that their footrule distance may stand for, times
    their length: by the footrule distance alone where all are equally long.
    share: of the rows that are reranked, the learnt one unless given.
    """
    files = InvertedFiles(permutations(rows, f.pivots, listed), len(f.pivots))
    size = _lengths(rows)
    take = min(len(rows), int(np.ceil((f.share if share is None else share) * len(rows))) + k)
    asked = permutations(queries, f.pivots, walked).tolist()
    out_q, out_r, out_s = [], [], []
    for q, order in enumerate(asked):
        worth = size * (f.a + f.b * files.agreement(order))
        some = np.argpartition(-worth, take - 1)[:take] if take < len(rows) else np.arange(len(rows))
        some = some[row_ids[some] != query_ids[q]]
        score = np.einsum("ij,j->i", rows[some], queries[q])
        if len(some) > k:
            top = score >= np.partition(score, len(some) - k)[len(some) - k]
            some, score = some[top], score[top]
        best = np.lexsort((row_ids[some], -score))[:k]
        out_q.append(np.full(len(best), q))
        out_r.append(some[best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


FOUND_ROWS = "query_id long, rank int, vec_id long, score double"


def _exact(rows: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, row_block: int) -> DataFrame:
    """query_id, vec_id, score of the k best rows of each block of rows, for queries of as many components."""
    parts = sizes.select("d", F.ceil(F.col("n") / row_block).cast("int").alias("parts"))
    left = rows.withColumn("d", F.size("embedding")).join(parts, "d").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    right = queries.withColumn("d", F.size("embedding")).join(parts, "d").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
        if not own.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = own.sort_by("vec_id")
        row_ids, query_ids = own.column("vec_id").to_numpy(), wanted.column("vec_id").to_numpy()
        x, y = _matrix(own.column("embedding")), _matrix(wanted.column("embedding"))
        out = []
        for q, me in zip(y, query_ids.tolist(), strict=True):
            score = np.where(row_ids == me, -np.inf, np.einsum("ij,j->i", x, q))
            best = np.lexsort((row_ids, -score))[:k]
            best = best[row_ids[best] != me]
            out.append((np.full(len(best), me), row_ids[best], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    key = ["d", "part"]
    both = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding").groupBy(*key))
    return both.applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query.

    Vectors that are null, zero or hold null or non-finite components take no
    part; rows that repeat a vec_id count once. An inner product is defined
    between vectors of equally many components only: a query is answered among
    those, by the index if they have the length of most and by exact products in
    blocks if not. Ties go to the smaller vec_id. Other columns are left out. The
    index is fitted on `sample` rows and holds every row.
    """
    spark = vectors.sparkSession
    use_package(spark)
    every = stash(usable(vectors), "usable")
    sizes = every.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.orderBy(F.desc("n"), "d").first()
    if facts is None:
        return spark.createDataFrame([], FOUND_ROWS)
    good = every.filter(F.size("embedding") == facts.d)
    wanted = usable(queries)
    asked = wanted.filter(F.size("embedding") == facts.d)
    f = fit(_matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding")), pivots, k=k)
    apart = len(f.pivots)  # the cell of long rows
    shared = spark.sparkContext.broadcast(f)

    def place(batches):
        f = shared.value
        for b in batches:
            x = _matrix(b.column("embedding"))
            cell = np.where(_lengths(x) > f.long, apart, (x @ f.pivots.T).argmax(axis=1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    kind = good.schema["embedding"].dataType.simpleString()
    placed = stash(good.mapInArrow(place, f"vec_id long, embedding {kind}, cell int"), "placed")
    rows = np.zeros(apart + 1, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most a row for each pivot
        rows[r.cell] = r["count"]
    bundle = np.append(bundle_cells(f.pivots, rows[:apart], row_block), 0)
    bundle[apart] = bundle.max() + 1
    parts = -(-np.bincount(bundle, rows) // row_block).astype(np.int64)
    shared_bundle = spark.sparkContext.broadcast(bundle)

    def route(batches):
        f, bundle = shared.value, shared_bundle.value
        always = [int(bundle[apart])] if rows[apart] else []
        for b in batches:
            x = _matrix(b.column("embedding"))
            near = permutations(x, f.pivots, f.probes)
            to = [np.unique(np.append(bundle[own], always).astype(np.int32)) for own in near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int32()))], [*b.schema.names, "to"])

    routed = stash(asked.mapInArrow(route, f"vec_id long, embedding {kind}, `to` array<int>"), "routed")
    visits = np.zeros(len(parts), np.int64)
    for r in routed.select(F.explode("to").alias("bundle")).groupBy("bundle").count().collect():
        visits[r.bundle] = r["count"]
    turns = np.maximum(-(-visits // QUERY_BLOCK), 1)
    facts_of = spark.createDataFrame([(i, int(p), int(t)) for i, (p, t) in enumerate(zip(parts, turns, strict=True)) if p], "bundle int, parts int, turns int")
    cells = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bundle)], "cell int, bundle int").join(facts_of, "bundle")
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Both small tables have at most a row for each pivot.
    left = placed.join(F.broadcast(cells), "cell").withColumn("part", dealt(F.col("parts"), 1)).withColumn("turn", all_of("turns"))
    right = routed.withColumn("bundle", F.explode("to")).join(F.broadcast(facts_of), "bundle").withColumn("turn", dealt(F.col("turns"), 2)).withColumn("part", all_of("parts"))
    key, long_rows = ["bundle", "part", "turn"], int(bundle[apart])

    def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
        if not own.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = own.sort_by("vec_id")
        row_ids, query_ids = own.column("vec_id").to_numpy(), wanted.column("vec_id").to_numpy()
        share = 1.0 if own.column("bundle")[0].as_py() == long_rows else None  # of few rows that may be near to any query
        q, r, s = search_part(_matrix(own.column("embedding")), row_ids, _matrix(wanted.column("embedding")), query_ids, shared.value, k, share=share)
        return pa.table({"query_id": query_ids[q], "vec_id": row_ids[r], "score": s})

    cogrouped = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding").groupBy(*key))
    found = stash(cogrouped.applyInArrow(search, "query_id long, vec_id long, score double"), "nearest")
    drop_stash(placed, routed)
    if facts.n < every.count():
        found = found.unionByName(_exact(every.filter(F.size("embedding") != facts.d), wanted, sizes, k, row_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
