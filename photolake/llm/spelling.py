"""Spelling variants: exact neighbours of words by pairs of trie nodes.

The nodes of a trie over all words and of one over all reversed words are
numbered. A word that is split at some place is a pair of numbers, that of the
node of what stands before (the prefix) and of what stands behind (the
suffix). Two words are near if they have a pair in common where one or both
skip a code point: (prefix, suffix behind the next code point) of both for a
replacement, of one and (prefix, suffix) of the other for an insertion. As the
numbers stand for whole prefixes and suffixes, no text is compared.

Tries are numbered where the words lie sorted over range partitions: a word
adds a node for each code point behind what it shares with the word before.
A partition's first word may share nodes with the one before; the two outer
words of every partition, collected by the driver, tell which.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from photolake.llm.keys import free_name
from photolake.session import stash, table, use_package

#: Runs of these letters in UTF-8, A-Z lower-cased before: a to z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
DAMAGED_BY = 97
MIN_LETTERS = 5
MIN_COUNT = 3
#: A form is so many times as frequent at least.
FORM_TIMES = 2
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000

REPLACED, STARTS, GAP = 0, 1, 2


def damaged(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def words_of(doc_id: str, text: str) -> Counter:
    """Words of at least MIN_LETTERS code points of a text, with their occurrences."""
    runs = Counter(RUN.findall(text.encode().lower()))  # bytes.lower() leaves other letters alone
    seed = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run, seed)
        word = damaged(run, h) if h % DAMAGED_BY == 0 else run
        if len(word) - word.count(b"\xc3") >= MIN_LETTERS:
            out[word] += n
    return out


def word_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """word and n, for words that occur `least` times over all documents."""
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    held.update(words_of(doc_id.as_py() or "", text.as_py()))
                    if len(held) >= HELD_WORDS:
                        yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """Code points that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def number_nodes(words: list[str], path: np.ndarray, last: str, used: int) -> tuple[list[np.ndarray], int]:
    """For each of the sorted words, the numbers of its trie nodes from depth 1 on; path and last: those of the word before."""
    out = []
    for word in words:
        k = shared(last, word)
        path = np.concatenate([path[:k], np.arange(used, used + len(word) - k)])
        used += len(word) - k
        last = word
        out.append(path)
    return out, used


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def with_nodes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the numbers of the nodes of each row's distinct key in the trie over all keys, root left out, as array `name`.

    Numbers begin at 1 and grow in the order in which sorted keys first need a node.
    """
    part, edge = free_name("_part", rows.columns), free_name("_edge", rows.columns)
    own, names = list(rows.schema), rows.columns
    numbers = StructField(name, ArrayType(LongType()))
    kind = StructType([*own, StructField(part, IntegerType()), StructField(edge, BooleanType()), numbers])
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path, last, used, first = None, np.zeros(0, np.int64), "", 0, True
        me = TaskContext.get().partitionId()

        def done(batch: pa.RecordBatch, nodes: list, begins: bool, ends: bool) -> pa.RecordBatch:
            edges = np.zeros(batch.num_rows, bool)
            edges[0] |= begins
            edges[-1] |= ends
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, me, np.int32)), pa.array(edges), _lists(nodes)], [*batch.schema.names, part, edge, name])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield done(*held, False)
            words = batch.column(at).to_pylist()
            nodes, used = number_nodes(words, path, last, used)
            path, last = nodes[-1], words[-1]
            held, first = (batch, nodes, first), False
        if held:
            yield done(*held, True)

    placed = stash(rows.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, kind), "nodes")
    outer: dict[int, list] = {}
    for r in placed.filter(edge).select(part, key, name).collect():  # two words a partition
        outer.setdefault(r[0], []).append((r[1], np.array(r[2], np.int64)))
    moves, used, before = {}, 1, None
    sizes = {r[0]: r[1] + 1 for r in placed.groupBy(part).agg(F.max(F.array_max(name))).collect()}
    for p in sorted(outer):
        words = sorted(outer[p], key=lambda x: x[0])
        k = shared(before[0], words[0][0]) if before else 0
        moves[p] = (used, before[1][:k] if before else np.zeros(0, np.int64))
        used += sizes[p]
        last, nodes = words[-1]
        before = (last, globally(nodes, *moves[p]))
    sent = rows.sparkSession.sparkContext.broadcast(moves)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names) + 2)
            flat, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            parts = np.repeat(batch.column(len(names)).to_numpy(), counts)
            for p in np.unique(parts).tolist():
                own = parts == p
                flat = np.where(own, globally(np.where(own, flat, 0), *sent.value[p]), flat)
            new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], new], [*names, name])

    return placed.mapInArrow(settle, StructType([*own, numbers]))


def globally(nodes: np.ndarray, offset: int, taken_over: np.ndarray) -> np.ndarray:
    """A partition's own numbers made unlike all others'; the first word's first nodes may be those of the partition before."""
    k = len(taken_over)
    if not k:
        return nodes + offset
    return np.where(nodes < k, taken_over[np.minimum(nodes, k - 1)], nodes + offset)


def postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All pairs (prefix node, suffix node) of words with columns word, n, fwd, bwd."""
    n_letters = batch.column("fwd").value_lengths().to_numpy().astype(np.int64)
    fwd, bwd = (batch.column(x).flatten().to_numpy() for x in ("fwd", "bwd"))
    letters = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
    first = np.cumsum(n_letters) - n_letters
    row = np.repeat(np.arange(len(n_letters)), n_letters + 1)
    i = np.arange(len(row)) - np.repeat(first + np.arange(len(n_letters)), n_letters + 1)  # 0 to length
    size, base = n_letters[row], first[row]

    def node(flat: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.where(depth > 0, flat[np.clip(base + depth - 1, 0, None)], 0) if len(flat) else np.zeros(0, np.int64)

    before, behind = node(fwd, i), node(bwd, size - i)
    skips = i < size
    after_next = node(bwd, np.maximum(size - i - 1, 0))[skips]
    starts = (i == 0) | (letters[np.minimum(base + i, len(letters) - 1)] != letters[np.clip(base + i - 1, 0, None)])
    # Taking one of several equal neighbouring letters gives one word: it counts at the first of them.
    kind = np.where(starts[skips], STARTS, REPLACED)
    ids = fwd[first + n_letters - 1]
    word = np.concatenate([row[skips], row])
    cols = [np.concatenate([before[skips], before]), np.concatenate([after_next, behind]), np.concatenate([kind, np.full(len(row), GAP)]).astype(np.int8), ids[word], batch.column("n").to_numpy()[word]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "b", "kind", "id", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best, struct(n, -id) of the near word of largest n and then smallest order, for words that have near ones.

    Under one pair stand at most one word without and, for each letter of the
    alphabet, one with a letter skipped: windows over pairs are small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield postings(batch.slice(at, 2000))

    posted = words.select("word", "n", "fwd", "bwd").mapInArrow(run, "a long, b long, kind byte, id long, n long")
    w = Window.partitionBy("a", "b")
    me, skips, gap, starts = F.struct("n", (-F.col("id")).alias("id")), F.col("kind") != GAP, F.col("kind") == GAP, F.col("kind") == STARTS
    seen = (
        posted.withColumn("me", me)
        .withColumn("others", F.count(F.lit(1)).over(w) - 1).filter("others > 0")
        .withColumn("n_skips", F.count(F.when(skips, 1)).over(w)).withColumn("n_starts", F.count(F.when(starts, 1)).over(w))
        .withColumn("top", F.max(F.when(skips, F.col("me"))).over(w)).withColumn("top_start", F.max(F.when(starts, F.col("me"))).over(w))
        .withColumn("without", F.max(F.when(gap, F.col("me"))).over(w))
        .withColumn("second", F.max(F.when(skips & (F.col("me") < F.col("top")), F.col("me"))).over(w))
    )
    other = F.when(F.col("me") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    near = F.when(gap, F.col("n_starts")).otherwise(F.col("n_skips") - 1 + (starts & F.col("without").isNotNull()).cast("int"))
    best = F.when(gap, F.col("top_start")).when(starts, F.greatest(other, F.col("without"))).otherwise(other)
    return seen.select("id", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root, from id and form: the ends of the chains, which have no form of their own.

    Counts at least double along a chain, so that it has under 62 words; each
    round doubles the way, hence six rounds at most.
    """
    at = stash(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stash(at.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least: int = MIN_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """Words with their near words' number, their form and their root.

    A null text has no words; a null doc_id stands for no digits before the
    colon that is hashed. Repeated rows count as often as they are there. Ties
    for the form go to the smallest word in code-point order. Other columns are
    left out; an empty table gives an empty result.
    """
    counted = word_counts(docs, least)
    forward = with_nodes(counted, "word", "fwd")
    both = stash(with_nodes(forward.withColumn("reversed", F.reverse("word")), "reversed", "bwd"), "words")
    words = both.select(F.element_at("fwd", -1).alias("id"), "word", "n")  # the last node is the word's own
    near = words.join(neighbours(both), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.struct((-F.col("best.id")).alias("id"), "best.n")).alias("form")
    )
    known = stash(near.select("id", "word", "n", "n_near", F.col("form.id").alias("form"), F.col("form.n").alias("form_n")), "near")
    ends = roots(known.filter("form is not null"))
    name = lambda column: words.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"))
    chained = known.filter("form is not null").join(ends, "id").join(name("form"), "form").join(name("root"), "root")
    plain = known.filter("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return chained.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n").unionByName(plain)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
