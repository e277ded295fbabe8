"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts items: the end of a text, the most frequent words, and
groups of all other words by their last two bytes. The vector of the item
before, times a context matrix, times the vectors of all items gives, with a
bias each, their scores; soft-max over these, one batched matrix product for all
contexts, makes them normalised log-probabilities. A word of a group has the
group's probability times its smoothed share of the group, in which words
never seen together count as one more word. So every text has a probability,
and those of all continuations sum to one.

All training documents count: words and pairs of neighbouring items are
counted by Spark, and the pairs, at most ITEMS squared, are all that the model
has to see. Noise is expected over the whole noise distribution rather than
drawn, so that fits repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from photolake.llm.textnum import U, Bytes, chunks, load, mix, words
from photolake.session import stash, table, use_package

#: Items that the model tells apart: the end, WORDS frequent words, GROUPS groups.
ITEMS, GROUPS = 1024, 256
WORDS = ITEMS - GROUPS - 1
#: Words whose counts every task holds, the most frequent ones (4 MB at most); those of others are joined.
HELD = 1 << 18
#: Length of item vectors, noise samples for each pair, and rounds of training.
WIDTH, NOISE, ROUNDS = 40, 10, 120
#: Strength of the pull of vectors to nought.
PULL = 0.5
#: Stands for the end among hashes of words, and its group.
END, NO_GROUP = U(0x5851F42D4C957F2D), GROUPS
FOLDS, LEFT_OUT = 5, 1
#: Tokens that a task counts at once.
COUNTED = 1 << 22


def held_out() -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == LEFT_OUT, F.lit(False))


@dataclass
class Tokens:
    """Words, A-Z lower-cased, and an end for each text; those of text i are first[i]..first[i+1]."""

    hash: np.ndarray
    group: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    t = load(texts)
    upper = (t.buf >= 65) & (t.buf <= 90)
    w = words(Bytes(np.where(upper, t.buf + 32, t.buf).astype(np.uint8), t.offsets))
    n = len(w.count)
    first = w.first + np.arange(n + 1)
    total = len(w.hash) + n
    at = np.arange(len(w.hash)) + w.doc
    hashes, groups = np.full(total, END), np.full(total, NO_GROUP, np.int16)
    hashes[at] = w.hash
    buf = w.text.buf
    last = buf[w.end - 1].astype(U) << U(8)
    last |= np.where(w.end - w.start > 1, buf[np.maximum(w.end - 2, 0)], 0).astype(U)
    groups[at] = (mix(last + U(1)) % U(GROUPS)).astype(np.int16)
    return Tokens(hashes, groups, first)


def count_words(docs: DataFrame) -> DataFrame:
    """h (hash), g (group) and c (occurrences) of every token of the documents."""
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []

        def out() -> pa.RecordBatch:
            h, at, c = np.unique(np.concatenate([x.hash for x in held]), return_index=True, return_counts=True)
            g = np.concatenate([x.group for x in held])[at]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), pa.array(c)], ["h", "g", "c"])

        for batch in batches:
            for part in chunks(batch, "text"):
                held.append(tokens(part.column("text")))
                if sum(len(x.hash) for x in held) >= COUNTED:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, g short, c long").groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task holds: counts of the most frequent words and what the model takes for an item of its own."""

    hash: np.ndarray  # sorted; int64, as Spark has them
    count: np.ndarray
    item_hash: np.ndarray  # sorted; the end and frequent words
    item: np.ndarray
    total: int  # training tokens
    distinct: int
    group_total: np.ndarray  # of words without an item of their own
    group_distinct: np.ndarray

    def items(self, t: Tokens) -> np.ndarray:
        h = t.hash.view(np.int64)
        at = np.minimum(np.searchsorted(self.item_hash, h), len(self.item_hash) - 1)
        return np.where(self.item_hash[at] == h, self.item[at], 1 + WORDS + t.group)

    def counts(self, t: Tokens) -> np.ndarray:
        """Occurrences in training; -1 where they aren't held."""
        if not len(self.hash):
            return np.full(len(t.hash), -1)
        h = t.hash.view(np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.count[at], -1)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From count_words(): whole steps of frequency, most frequent first, as long as HELD words suffice."""
    step = F.floor(F.log2("c") * 8)
    steps = {r[0]: r[1] for r in counted.groupBy(step.alias("step")).count().collect()}  # eight for each doubling
    least, room = max(steps, default=-1) + 1, HELD
    while least > 0 and steps.get(least - 1, 0) <= room:
        least -= 1
        room -= steps.get(least, 0)
    sums = {r["g"]: (r["total"], r["distinct"]) for r in counted.groupBy("g").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).collect()}
    top = counted.filter((step >= least) | (F.col("h") == int(END.view(np.int64)))).toArrow().sort_by("h")  # what is an item of its own is always held
    h, g, c = (top.column(x).to_numpy() for x in ("h", "g", "c"))
    own = np.flatnonzero(g != NO_GROUP)
    own = own[np.lexsort((h[own], -c[own]))[:WORDS]]
    item_hash = np.concatenate([h[own], [END.view(np.int64)]])
    order = np.argsort(item_hash)
    total, distinct = (np.array([sums.get(k, (0, 0))[i] for k in range(GROUPS + 1)], np.int64) for i in (0, 1))
    rest = [x[:GROUPS] - np.bincount(g[own], w, GROUPS + 1)[:GROUPS].astype(np.int64) for x, w in ((total, c[own]), (distinct, np.ones(len(own))))]
    return Vocabulary(h, c, item_hash[order], np.append(1 + np.arange(len(own)), 0)[order], int(total.sum()), int(distinct.sum()), *rest)


def before(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The item before each; the end before a text's first."""
    out = np.zeros_like(items)
    out[1:] = items[:-1]
    out[first[:-1]] = 0
    return out


def count_pairs(docs: DataFrame, known: Vocabulary) -> np.ndarray:
    """How often each item follows each, in all documents: a table of ITEMS squared numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                t = tokens(part.column("text"))
                items = sent.value.items(t)
                held += np.bincount(before(items, t.first) * ITEMS + items, minlength=ITEMS * ITEMS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["pair", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ITEMS * ITEMS)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(ITEMS, ITEMS)


@dataclass
class Model:
    """Score of item j behind item i: vectors[i] @ context @ targets[j] + bias[j]."""

    vectors: np.ndarray
    context: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def log10_probabilities(self) -> np.ndarray:
        """Normalised, for all contexts at once: [item before, item]."""
        s = (self.vectors @ self.context) @ self.targets.T + self.bias
        s -= s.max(axis=1, keepdims=True)
        return ((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float64)


def train(pairs: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Noise-contrastive estimation: tell each pair from NOISE pairs of the same context and an item by its frequency alone.

    The logit of "not noise" is the score less log(NOISE * noise probability).
    Steps are Adam's over the whole table.
    """
    n = len(pairs)
    r = np.random.default_rng(0)
    frequency = pairs.sum(axis=0) + 0.5
    noise = frequency / frequency.sum()
    of_context = pairs.sum(axis=1)
    scale = 1 / max(of_context.sum(), 1)
    weight = np.sqrt((of_context + 1) * scale)[:, None]  # evens out frequent and rare contexts
    data = (pairs * scale / weight).astype(np.float32)
    against = (NOISE * (of_context * scale)[:, None] * noise / weight).astype(np.float32)
    p = [(0.1 * r.standard_normal((n, WIDTH))).astype(np.float32), np.eye(WIDTH, dtype=np.float32), (0.1 * r.standard_normal((n, WIDTH))).astype(np.float32), np.log(noise).astype(np.float32)]
    pull = np.float32(PULL * np.sqrt(scale))  # of vectors to nought, the weaker the more there is to learn from
    shift = np.log(NOISE * noise).astype(np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
    for k in range(rounds if of_context.any() else 0):
        vectors, context, targets, bias = p
        seen = vectors @ context
        real = 1 / (1 + np.exp(-np.clip(seen @ targets.T + bias - shift, -30, 30)))  # probability of not being noise
        g = real * (data + against) - data
        g_seen = g @ targets
        grads = [g_seen @ context.T, vectors.T @ g_seen, g.T @ seen, g.sum(axis=0)]
        grads[0] += pull * vectors
        grads[2] += pull * targets
        rate = 0.05 * min(1, 3 * (1 - k / rounds))
        for x, d, (m, v) in zip(p, grads, moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
    return Model(*p)


def score_rows(docs: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """One row a document: tokens, those known to be known, both scores as far as they go without the words in `tail`, whose counts aren't held."""
    sent = docs.sparkSession.sparkContext.broadcast((known, model))
    kinds = [StructField("row", LongType()), docs.schema["doc_id"], StructField("held_out", BooleanType())]
    kind = StructType([*kinds, StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()), StructField("model", DoubleType()), StructField("tail", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, m = sent.value
        likely = m.log10_probabilities()
        within = -np.log10(voc.group_total + 0.5 * (voc.group_distinct + 1))
        outside = -np.log10(voc.total + 0.5 * (voc.distinct + 1))
        for batch in batches:
            for part in chunks(batch, "text"):
                t = tokens(part.column("text"))
                n = len(t.first) - 1
                doc = np.repeat(np.arange(n), np.diff(t.first))
                items, c = voc.items(t), voc.counts(t)
                share = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                base = share + outside
                own = likely[before(items, t.first), items] + np.where(items > WORDS, share + within[np.maximum(items - 1 - WORDS, 0)], 0.0)
                far = c < 0
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[far], minlength=n))]), pa.int32()), pa.array(t.hash[far].view(np.int64)))
                sums = [np.diff(t.first).astype(np.int64), np.bincount(doc[c > 0], minlength=n).astype(np.int64), np.bincount(doc, base, n), np.bincount(doc, own, n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, sums), tail], kind.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every document.

    Learns from all documents but the held-out ones. A null or empty text has
    its end alone; a null doc_id is learnt from. Repeated rows are learnt from
    as often as they are there and get equal scores. Other columns are left
    out. With nothing to learn from all words count as unseen. An empty table
    gives an empty result.
    """
    use_package(docs.sparkSession)
    learnt = docs.filter(~held_out())
    counted = stash(count_words(learnt), "words")
    known = vocabulary(counted)
    model = train(count_pairs(learnt, known))
    rows = stash(score_rows(docs, known, model), "scored")
    missing = rows.select("row", F.explode("tail").alias("h")).join(counted.select("h", "c"), "h", "left")
    found = missing.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_more"), F.count("c").alias("_known"))
    more, also = F.coalesce("_more", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return rows.drop("tail").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + also).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
