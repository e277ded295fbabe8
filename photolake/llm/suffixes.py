"""Repeated passages by sparse suffix arrays.

Of all suffixes only those at minimisers are kept: the position with the
smallest hash of KEY words in each run of positions, chosen by content, so a
passage that repeats brings its minimisers along. The suffixes are sorted by
their first KEY words over all documents, and one whose neighbour in that order
begins alike is a match. A match may reach least - KEY words to either side, so
the suffixes at all words in that reach are sorted once more, now by `least`
words, and compared with their neighbours again: that extends every match to
both sides, word by word, against all its partners. (Extending only against the
neighbour by the first words would miss passages: the suffix that shares most
to the right need not share anything to the left.) Both orders are range
partitionings by (words, doc_id, word) with rows of a few bytes, so a passage
that a large part of all documents shares is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.keys import free_name, row_keys
from photolake.llm.textnum import U, Words, chunks, load, mix, words
from photolake.session import drop_stash, stash, table, use_package

#: Least length of a passage in words.
LEAST = 50
KEY = 12


def _runs(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; meaningless where the text has fewer left. Built up by doubling, mixed at each step."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, U)
    power, width = w.hash, 1  # hash of `width` words from each word on
    out, done = np.zeros(total + 1 - n, U), 0
    while True:
        if n & width:
            out = mix(out + power[done : done + len(out)])
            done += width
        if 2 * width > n:
            return out
        power = mix(power[: len(power) - width] * U(0xBF58476D1CE4E5B9) + power[width:])
        width *= 2


def minimisers(w: Words, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of its key words) of the positions kept: in every text of `least` words or more, each run of `least` words holds one with all its key words."""
    h = _runs(w, key)
    width = least - key + 1
    total = len(h)
    if total < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    bits = U(int(total).bit_length())
    ranked = (h >> bits << bits) | np.arange(total, dtype=U)  # ties go to the left
    lowest, span = ranked, 1
    while 2 * span <= width:
        lowest = np.minimum(lowest[: len(lowest) - span], lowest[span:])
        span *= 2
    if span < width:
        lowest = np.minimum(lowest[: total - width + 1], lowest[width - span : total - span + 1])
    at = np.arange(total - width + 1)
    inside = at + least <= w.first[1:][w.doc[: len(at)]]
    kept = np.unique((lowest[inside] & ((U(1) << bits) - U(1))).astype(np.int64))
    return kept, h[kept]


def sparse_suffixes(docs: DataFrame, key: int = KEY, least: int = LEAST) -> DataFrame:
    """head (hash of the first key words), doc_id, word of each kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(load(part.column("text")))
                at, head = minimisers(w, key, least)
                doc = w.doc[at]
                ids = part.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), ids, pa.array((at - w.first[:-1][doc]).astype(np.int32))], ["head", "doc_id", "word"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "head long, doc_id long, word int")


def matching(suffixes: DataFrame) -> DataFrame:
    """doc_id, word of suffixes whose neighbour in sorted order begins with the same words.

    The first and last row of a sorted partition are kept whatever they are,
    since their neighbour is in another one; extension tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether it has matched yet
        names = ["doc_id", "word"]
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            head = b.column("head").to_numpy()
            same = np.zeros(len(head) + 1, bool)
            same[1:-1] = head[1:] == head[:-1]
            if held is not None:
                same[0] = held[0] == head[0]
                if held[2] or same[0]:
                    yield held[1]
            hit = same[:-1] | same[1:]
            if first:
                hit[0], first = True, False
            body = b.select(names)
            last = len(head) - 1
            held = (head[last], body.slice(last, 1), hit[last])
            yield body.slice(0, last).filter(pa.array(hit[:last]))
        if held is not None:
            yield held[1]

    ordered = suffixes.repartitionByRange("head", "doc_id", "word").sortWithinPartitions("head", "doc_id", "word")
    return ordered.mapInArrow(run, "doc_id long, word int")


def extended(docs: DataFrame, matches: DataFrame, key: int = KEY, least: int = LEAST) -> DataFrame:
    """window (hash of `least` words), doc_id, word for all windows that hold a matching suffix with its key words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(load(part.column("text")))
                h = _runs(w, least)
                lists = part.column("at")
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lo = np.maximum(at + key - least, 0)
                hi = np.minimum(at, w.count[doc] - least)
                ok = hi >= lo
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, (w.first[:-1][doc] + lo)[ok], 1)
                np.add.at(cover, (w.first[:-1][doc] + hi + 1)[ok], -1)
                start = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                own = w.doc[start]
                ids = part.column("doc_id").take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), ids, pa.array((start - w.first[:-1][own]).astype(np.int32))], ["window", "doc_id", "word"])

    places = matches.groupBy("doc_id").agg(F.collect_list("word").alias("at"))
    return docs.select("doc_id", "text").join(places, "doc_id").mapInArrow(run, "window long, doc_id long, word int")


def shared_windows(windows: DataFrame) -> DataFrame:
    """doc_id, word, duplicate of windows that more than one document holds, by comparing neighbours in sorted order.

    A run of equal windows belongs to the document of its first row; rows of
    other documents are duplicates wherever the run began. The first run of a
    partition may have begun before it, and the last may go on after it: for
    the rows of the run's first document there, duplicate is null, window is
    given, and met says whether another document's row was seen.
    """
    names = ["doc_id", "word", "duplicate", "window", "met"]

    def settled(b: pa.RecordBatch, duplicate: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("word"), pa.array(np.full(b.num_rows, duplicate)), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.bool_())], names)

    def left_open(b: pa.RecordBatch, met: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("word"), pa.nulls(b.num_rows, pa.bool_()), b.column("window"), pa.array(np.full(b.num_rows, met))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The run at the end so far: its window, first document, whether others hold it, whether it is the partition's first, the first document's rows.
        at, owner, met, first, held = None, None, False, True, []

        def ended() -> Iterator[pa.RecordBatch]:
            for x in held:
                if first:
                    yield left_open(x, met)
                elif met:
                    yield settled(x, False)

        for b in batches:
            if not b.num_rows:
                continue
            window, doc = b.column("window").to_numpy(), b.column("doc_id").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            size = np.diff(np.append(start, len(window)))
            owners = doc[start]
            if at is not None and window[0] == at:
                owners[0] = owner
            elif at is not None:
                yield from ended()
                met, first, held = False, False, []
            later = doc > np.repeat(owners, size)
            yield settled(b.filter(pa.array(later)), True)
            seen = np.logical_or.reduceat(later, start)
            # The first and the last run of the batch are held, others end here.
            held.append(b.slice(0, size[0]).filter(pa.array(~later[: size[0]])))
            met |= bool(seen[0])
            if len(start) > 1:
                yield from ended()
                inner = ~later & np.repeat(seen, size)
                inner[: size[0]] = inner[start[-1] :] = False
                yield settled(b.filter(pa.array(inner)), False)
                held, met, first = [b.slice(start[-1]).filter(pa.array(~later[start[-1] :]))], bool(seen[-1]), False
            at, owner = window[-1], owners[-1]
        for x in held:
            yield left_open(x, met)

    kind = "doc_id long, word int, duplicate boolean, window long, met boolean"
    ordered = windows.repartitionByRange("window", "doc_id", "word").sortWithinPartitions("window", "doc_id", "word")
    return ordered.mapInArrow(run, kind)


def settle(found: DataFrame) -> DataFrame:
    """doc_id, word, duplicate from what shared_windows() gives: rows left open look at the first documents of their window's run in other partitions."""
    owners = found.filter("window is not null").groupBy("window").agg(F.min("doc_id").alias("owner"), (F.max("met") | (F.min("doc_id") < F.max("doc_id"))).alias("shared")).filter("shared")
    # At most two windows for each partition of the sort.
    opened = found.join(F.broadcast(owners), "window").select("doc_id", (F.col("owner") < F.col("doc_id")).alias("duplicate"), "word")
    return found.filter("window is null").select("doc_id", "duplicate", "word").unionByName(opened)


def _spans(words_at: list[int], least: int) -> list[tuple[int, int]]:
    """Windows that overlap or touch joined to [start, end)."""
    at = np.unique(np.asarray(words_at, np.int64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > least)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + least).tolist(), strict=True))


def repeated_spans(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """doc_id, start_word, end_word, duplicate: passages of `least` words or more that other documents hold too.

    Words are runs of characters other than ASCII white space and must match
    exactly. duplicate is true where each window of the passage is also in a
    document with a smaller doc_id, false for the windows of which this
    document is the first holder. Repeats within one document alone don't
    count. Null texts, null ids and texts under `least` words have no passages.
    Rows that repeat a doc_id count as one document. Extra columns are left out.
    """
    use_package(docs.sparkSession)
    suffixes = stash(sparse_suffixes(docs, key, least), "suffixes")
    windows = stash(extended(docs, matching(suffixes), key, least), "windows")
    drop_stash(suffixes)
    shared = stash(shared_windows(windows), "shared")
    drop_stash(windows)
    found = settle(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, dup, at in zip(b.column("doc_id").to_pylist(), b.column("duplicate").to_pylist(), b.column("at"), strict=True):
                out += [(doc, s, e, dup) for s, e in _spans(at.values.to_numpy(), least)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start_word", "end_word", "duplicate"])

    grouped = found.groupBy("doc_id", "duplicate").agg(F.collect_list("word").alias("at"))
    return grouped.mapInArrow(run, "doc_id long, start_word long, end_word long, duplicate boolean")


def remove_repeats(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """The documents without the passages that a document with a smaller doc_id holds too; n_chars follows the text.

    The rest of a text stays as it is, its pieces joined by one blank. A text
    of which nothing is left goes. All columns stay; a text without such
    passages, a null one included, isn't touched. Rows without a doc_id, or
    whose doc_id names several texts, come after all others (row_keys()).
    """
    use_package(docs.sparkSession)
    names = docs.columns
    by, found = free_name("_key", names), free_name("_spans", names)
    keyed = row_keys(docs, by)
    spans = repeated_spans(keyed.select(F.col(by).alias("doc_id"), "text"), least, key).filter("duplicate")
    spans = stash(spans.groupBy(F.col("doc_id").alias(by)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(found)), "spans")
    joined = keyed.join(spans, by, "left")
    at, counts = names.index("text"), "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lists = part.column(found).to_pylist()
                hit = [i for i, x in enumerate(lists) if x]
                cols = [part.column(c) for c in names]
                if not hit:
                    yield pa.RecordBatch.from_arrays(cols, names)
                    continue
                texts = part.column("text").to_pylist()
                some = part.take(pa.array(hit))
                t = load(some.column("text"))
                w = words(t)
                raw = t.buf.tobytes()
                for k, i in enumerate(hit):
                    a, z = int(t.offsets[k]), int(t.offsets[k + 1])
                    pieces, here = [], a
                    for s in lists[i]:
                        s0, s1 = int(w.start[w.first[k] + s["start_word"]]), int(w.end[w.first[k] + s["end_word"] - 1])
                        pieces.append(raw[here:s0])
                        here = max(here, s1)
                    pieces.append(raw[here:z])
                    texts[i] = " ".join(p for p in (x.decode().strip() for x in pieces) if p)
                cols[at] = pa.array(texts, pa.string())
                if counts:
                    old = part.column("n_chars").to_pylist()
                    for i in hit:
                        old[i] = len(texts[i])
                    cols[names.index("n_chars")] = pa.array(old, pa.int64())
                gone = {i for i in hit if not texts[i]}
                out = pa.RecordBatch.from_arrays(cols, names)
                yield out.filter(pa.array([i not in gone for i in range(len(texts))])) if gone else out

    return joined.select(*names, found).mapInArrow(run, docs.schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
