"""Quality classifier: a support vector machine on naive-Bayes features.

N-gram indicators are scaled by the log ratio of their counts among good and
bad documents, then a linear hinge-loss model is fitted by dual coordinate
descent. A bounded number of labelled rows is used for fitting, the smallest
hashes first, so the choice doesn't depend on how rows are laid out. Margins
of rows left out of the fit, fold by fold, set the map to probabilities.
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

#: Documented bound: labelled rows that the classifier is fitted on.
FIT_ROWS = 3000
ACCEPT_FROM = 0.7
FOLDS = 3


def held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    """Hashed features of at most `rows` labelled documents outside the held-out part, with their labels.

    The chosen ids are few and are broadcast, so the documents aren't shuffled.
    """
    use_package(docs.sparkSession)
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                indptr, index = linear.features(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), found], ["doc_id", "_y", "_f"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id are learnt from once.
    return picked.mapInArrow(run, "doc_id long, _y int, _f array<int>").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("_f").alias("_f")).toArrow().sort_by("doc_id")


def _sparse(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = found.column("_f").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), found.column("_y").to_numpy()


def _rows(indptr: np.ndarray, index: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(indptr)
    return np.concatenate([[0], np.cumsum(counts[keep])]), index[np.repeat(keep, counts)]


def _fit(indptr, index, y, width):
    """Weight per feature (ratio times learnt weight, by the norm of a row's features) and intercept."""
    ratio = linear.log_count_ratio(indptr, index, y, width)
    value = ratio[index]
    norm = np.sqrt(np.maximum(linear.row_sums(indptr, value**2), 1e-12))
    value = value / np.repeat(norm, np.diff(indptr))
    w, b = linear.dual_coordinate_descent(indptr, index, value, np.where(y > 0, 1.0, -1.0), width)
    return ratio, w, b


def _margins(model, indptr, index):
    ratio, w, b = model
    value = ratio[index]
    norm = np.sqrt(np.maximum(linear.row_sums(indptr, value**2), 1e-12))
    return linear.row_sums(indptr, value * w[index]) / norm + b


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict:
    """The fitted model: ratios, weights, intercept and probability map. Without two classes to learn from it only knows the share of good rows."""
    width = 1 << linear.BITS
    found = labelled_sample(docs, labels, label, rows)
    indptr, index, y = _sparse(found) if found.num_rows else (np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"model": (np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0), "map": (0.0, float(np.log((share + 0.01) / (1.01 - share))))}
    fold = np.arange(len(y)) % FOLDS
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if len(set(y[~own].tolist())) < 2:
            continue
        out[own] = _margins(_fit(*_rows(indptr, index, ~own), y[~own], width), *_rows(indptr, index, own))
    ratio, w, b = _fit(indptr, index, y, width)
    return {"model": (ratio.astype(np.float32), w.astype(np.float32), b), "map": linear.platt(out, y)}


def score_quality(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id and score of every whole text. Only the text is looked at; a null text is scored as an empty one."""
    use_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (a, b) = shared.value["model"], shared.value["map"]
        for batch in batches:
            for part in chunks(batch, "text"):
                z = a * _margins(model, *linear.features(part.column("text"))) + b
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_accepted(docs: DataFrame, labels: DataFrame, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """The documents that the classifier accepts, all columns, in one pass over the texts."""
    fitted = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (a, b) = shared.value["model"], shared.value["map"]
        for batch in batches:
            for part in chunks(batch, "text"):
                z = a * _margins(model, *linear.features(part.column("text"))) + b
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= accept_from))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """Fit on the labels and score all documents: doc_id, held_out, score, predicted.

    Labels without a document and documents without a label are both fine; an
    empty table of either kind gives scores at the share of good rows (0.5 if
    unknown). Repeated rows get equal scores; extra columns are left out.
    """
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept_from).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
