"""Toxicity categories by a chain of linear classifiers.

The models come one after the other; each sees the text's n-gram indicators
and the probabilities of the categories before it. A model that learnt from
probabilities its predecessors give to their own training rows would trust
them too much, so those are out-of-fold: each comes from a predecessor fitted
without that row.

The labels only say toxic or not. The categories before that one are the two
kinds into which the labelled toxic texts themselves fall: clusters of what
tells them from clean texts, found on the rows that the chain is fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm import linear
from photolake.llm.textnum import chunks
from photolake.session import table, use_package

#: Documented bound: labelled rows of either class that the chain is fitted on.
FIT_ROWS = 2000
TOXIC_FROM = 0.5
FOLDS = 3
#: The chain's categories in order: the two kinds of toxic texts, and toxic as labelled.
CHAIN = ("kind_1", "kind_2", "toxic")
#: Features that clusters are told apart by.
TELLING = 512


def kinds(indptr: np.ndarray, index: np.ndarray, toxic: np.ndarray, width: int, rounds: int = 20) -> np.ndarray:
    """Labels of the chain's categories, a column each, from the toxic labels.

    Two-means over the toxic rows' telling features, each scaled by its log-count
    ratio; the first kind is the larger. All toxic rows are of the first kind if
    they don't differ.
    """
    out = np.zeros((len(toxic), 3), np.int64)
    out[:, 2] = toxic > 0
    own = np.flatnonzero(toxic > 0)
    out[own, 0] = 1
    if len(own) < 4 or len(own) == len(toxic):
        return out
    ratio = np.maximum(linear.log_count_ratio(indptr, index, toxic, width), 0)
    counts = np.diff(indptr)
    row, feature = np.repeat(np.arange(len(toxic)), counts), index
    mine = toxic[row] > 0
    worth = np.bincount(feature[mine], minlength=width) * ratio
    telling = np.argsort(-worth, kind="stable")[:TELLING]
    place = np.full(width, -1)
    place[telling] = np.arange(len(telling))
    at = np.full(len(toxic), -1)
    at[own] = np.arange(len(own))
    keep = mine & (place[feature] >= 0)
    x = np.zeros((len(own), len(telling)))
    x[at[row[keep]], place[feature[keep]]] = ratio[feature[keep]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    first = x[int((x @ x.mean(axis=0)).argmax())]
    centre = np.stack([first, x[int((x @ first).argmin())]])
    for _ in range(rounds):
        kind = (x @ centre.T).argmax(axis=1)
        for k in range(2):
            if (kind == k).any():
                m = x[kind == k].sum(axis=0)
                centre[k] = m / max(np.linalg.norm(m), 1e-12)
    small = kind == (0 if (kind == 0).sum() < (kind == 1).sum() else 1)
    out[own[small], 0], out[own[small], 1] = 0, 1
    return out


def _with_extra(indptr, index, value, extra, width):
    """The rows with one more entry for each extra column."""
    n, k = extra.shape
    counts = np.diff(indptr)
    grown = np.concatenate([[0], np.cumsum(counts + k)])
    at = np.arange(len(index)) + k * np.repeat(np.arange(n), counts)
    out_i, out_v = np.empty(grown[-1], np.int64), np.empty(grown[-1])
    out_i[at], out_v[at] = index, value
    for j in range(k):
        out_i[grown[1:] - k + j] = width + j
        out_v[grown[1:] - k + j] = extra[:, j]
    return grown, out_i, out_v


def _scaled(ratio, indptr, index):
    value = ratio[index]
    norm = np.sqrt(np.maximum(linear.row_sums(indptr, value**2), 1e-12))
    return value / np.repeat(norm, np.diff(indptr))


def _fit_link(indptr, index, extra, y, width):
    if len(set(y.tolist())) < 2:
        return np.zeros(width), np.zeros(width), np.zeros(extra.shape[1]), -1.0 if not len(y) or y[0] == 0 else 1.0
    ratio = np.maximum(linear.log_count_ratio(indptr, index, y, width), 0)  # what clean texts have says nothing about the rest of a text
    rows = _with_extra(indptr, index, _scaled(ratio, indptr, index), extra, width)
    w, b = linear.dual_coordinate_descent(*rows, np.where(y > 0, 1.0, -1.0), width + extra.shape[1], cost=4.0)
    return ratio, w[:width], w[width:], b


def _margin(link, indptr, index, extra):
    ratio, w, v, b = link
    return linear.row_sums(indptr, _scaled(ratio, indptr, index) * w[index]) + extra @ v + b


def _probability(map_, margin):
    return 1 / (1 + np.exp(-np.clip(map_[0] * margin + map_[1], -500, 500)))


def fit_chain(indptr: np.ndarray, index: np.ndarray, labels: np.ndarray, width: int, folds: int = FOLDS) -> list[dict]:
    """One link for each column of labels (0 or 1), in order."""
    n, k = labels.shape
    fold = np.arange(n) % folds
    extra, links = np.zeros((n, 0)), []
    counts = np.diff(indptr)
    for j in range(k):
        y, out = labels[:, j], np.zeros(n)
        for f in range(folds):
            own = fold == f
            some = lambda keep: (np.concatenate([[0], np.cumsum(counts[keep])]), index[np.repeat(keep, counts)])
            out[own] = _margin(_fit_link(*some(~own), extra[~own], y[~own], width), *some(own), extra[own])
        map_ = linear.platt(out, y) if len(set(y.tolist())) > 1 else (0.0, -6.0 if not len(y) or y[0] == 0 else 6.0)
        links.append({"link": _fit_link(indptr, index, extra, y, width), "map": map_})
        extra = np.column_stack([extra, _probability(map_, out)])
    return links


def run_chain(links: list[dict], indptr: np.ndarray, index: np.ndarray) -> np.ndarray:
    extra = np.zeros((len(indptr) - 1, 0))
    for x in links:
        extra = np.column_stack([extra, _probability(x["map"], _margin(x["link"], indptr, index, extra))])
    return extra


def _rows_to_fit(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    each = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = each.filter("_y > 0").orderBy(*order).limit(rows).unionByName(each.filter("_y <= 0").orderBy(*order).limit(rows))
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                indptr, index = linear.features(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), found], ["doc_id", "_y", "_f"])

    made = picked.mapInArrow(run, "doc_id long, _y int, _f array<int>")
    return made.groupBy("doc_id").agg(F.max("_y").alias("_y"), F.min("_f").alias("_f")).toArrow().sort_by("doc_id")


def detect(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, a probability for each category of the chain, and toxic (1 or 0) of every whole text.

    Fitted on at most `rows` labelled documents of either class, those with the
    smallest hashed ids; of a document labelled twice the higher label counts. A
    null text counts as empty; without labels of both
    classes nothing is called toxic. Repeated rows get equal results; columns
    other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    use_package(spark)
    width = 1 << linear.BITS
    found = _rows_to_fit(docs, labels, label, rows)
    if found.num_rows:
        lists = found.column("_f").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        indptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        index = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        y = kinds(indptr, index, found.column("_y").to_numpy(), width)
    else:
        indptr, index, y = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, len(CHAIN)))
    links = fit_chain(indptr, index, y, width)
    for x in links:
        ratio, w, v, b = x["link"]
        x["link"] = (ratio.astype(np.float32), w.astype(np.float32), v, b)
    shared = spark.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                p = run_chain(shared.value, *linear.features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, j]) for j in range(len(CHAIN)))], ["doc_id", *(f"p_{c}" for c in CHAIN)])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return scored.withColumn("toxic", (F.col("p_toxic") >= toxic_from).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
