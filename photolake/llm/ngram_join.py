"""Similarity join of documents on their sets of word n-grams.

Documents with equal n-gram sets form a class, found by one aggregation; only
one representative of each class goes on. MinHash signatures of representatives
are cut into bands; bands that agree propose pairs, and each proposed pair is
verified on the two full n-gram sets. Links between representatives then stand
for all links between their classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.keys import ODD, row_keys
from photolake.llm.textnum import U, chunks, load, mix, shingles, words
from photolake.session import drop_stash, stash, table, use_package

WORDS = 5
SIMILARITY = 0.8
#: Wanted share of pairs at exactly the threshold that the bands propose; more alike pairs are found more surely.
RECALL = 0.9999
#: Bands with more documents than this are verified in blocks of about BLOCK documents by BLOCK, of about BLOCK_GRAMS n-grams each.
CROWDED, BLOCK, BLOCK_GRAMS = 32, 256, 1 << 20
#: Longest signature that is worth its time.
MOST_HASHES = 96


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows a band): the most selective bands whose signature stays within `most` hashes and meets the recall.

    A pair of similarity s agrees in a band of r rows with probability s**r, so
    b bands miss it with probability (1 - s**r)**b.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity**rows < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} hashes finds {recall:.4%} of pairs at {similarity}")
    return best


def _ngram_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, end to end, and where each text's begin."""
    w = words(load(part.column("text")))
    h, at = shingles(w, n)
    edge = np.searchsorted(at, w.first)
    own = [np.sort(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    own = [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in own]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    return (np.concatenate(own) if own else np.zeros(0, U)), begin


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """doc_id, number of distinct n-grams, a 128-bit digest of their set, and one hash for each band (none without words)."""
    use_package(docs.sparkSession)
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, begin = _ngram_sets(part, n)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                start = begin[:-1][full]
                digest = np.zeros((2, len(size)), U)
                keys = np.zeros((len(size), bands), np.int64)
                if len(full):
                    for k in range(2):
                        digest[k, full] = np.add.reduceat(mix(h + U(k * 77 + 1)), start)
                    low = (h >> U(32)).astype(np.uint32)
                    for b in range(bands):
                        key = np.full(len(full), U(b + 1))
                        for r in range(b * rows, b * rows + rows):
                            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(low * factor[r] + shift[r], start))
                        keys[full, b] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                cols = [part.column("doc_id"), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "size", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, d1 long, d2 long, bands array<long>")


def ngram_sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id and the sorted distinct n-gram hashes of each text."""
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, begin = _ngram_sets(part, n)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


#: What equal n-gram sets agree in: a digest and their size.
SET = ["d1", "d2", "size"]


def equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, told) from doc_id and SET: the rows with the part they are sorted into, and representative (smallest doc_id of an equal set) and copies for each part and set.

    Rows are sorted over range partitions, and a set that fills several has an
    entry for each, so that no join on (_part, *SET) brings all its rows together.
    """
    placed = stash(sets.select("doc_id", *SET).repartitionByRange(*SET, "doc_id").withColumn("_part", F.spark_partition_id()), "placed")
    some = placed.groupBy("_part", *SET).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = some.groupBy(*SET).agg(F.min("least").alias("representative"), F.sum("n").alias("copies"))
    return placed, stash(some.select("_part", *SET).join(whole, SET), "told")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for the nodes of undirected edges (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours
    are hooked to its smallest one, then its smaller neighbours are. Either step
    is a minimum by node and a join; each round's edges are written, so a lost
    executor costs no more than a round.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least.select("u", "m")).distinct()
        before, now = now, stash(small, "edges")
        drop_stash(before)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        seen = mark
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _crowd_links(similarity: float, bands: int):
    """For applyInArrow over the documents of one crowded band that fall into two blocks i <= j.

    Verifies all pairs between the blocks (within, if i = j) on full n-gram
    sets. Gives for each document the links counted here, and the smallest
    document that those links lead to within the group; no pairs.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, copies, block = (t.column(c).to_numpy() for c in ("doc_id", "copies", "block"))
        pos = t.column("pos")[0].as_py()
        n = len(ids)
        lists = t.column("grams").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        gram, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), size)
        order = np.argsort(gram)
        gram, row = gram[order], row[order]
        same = np.zeros(len(gram) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        shared = same[:-1] | same[1:]  # others are in no intersection
        gram, row = gram[shared], row[shared]
        code = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        both = np.zeros((n, n), np.float32)
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            x, y = np.searchsorted(code, [first, first + 4096])
            held = np.zeros((n, 4096), np.float32)
            held[row[x:y], code[x:y] - first] = 1
            both += held @ held.T
        alike = both / (size[:, None] + size[None, :] - both) >= similarity
        np.fill_diagonal(alike, False)
        if (block != block[0]).any():
            alike &= block[:, None] != block[None, :]
        # A pair that meets in several crowded bands is counted in the first of them.
        crowd = np.repeat(-1 - np.arange(n, dtype=np.int64)[:, None], bands, axis=1)
        for i, own in enumerate(t.column("crowds").to_pylist()):
            for x in own:
                crowd[i, x["pos"]] = x["band"] & 0x7FFFFFFFFFFFFFFF
        p, q = np.nonzero(np.triu(alike))
        earlier = np.zeros(len(p), bool)
        for k in range(pos):
            earlier |= crowd[p, k] == crowd[q, k]
        p, q = p[~earlier], q[~earlier]
        near = np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        others = np.bincount(p, copies[q], minlength=n) + np.bincount(q, copies[p], minlength=n)
        by_id = np.argsort(np.argsort(ids, kind="stable"))
        label, before = by_id, None
        while before is None or (label != before).any():
            before, label = label, np.minimum(label, np.where(alike, label[None, :], n).min(axis=1))
        root = np.sort(ids)[label]
        return pa.table({"representative": ids, "others": others.astype(np.int64), "n_near": near.astype(np.int64), "root": root})

    return run


def similarities(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, crowded: int = CROWDED, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, told, bare, counts, edges).

    rows and told: equal_sets() of all documents with words; bare: doc_id of the
    others. counts: representative, others (documents of
    the classes linked to it), n_near (number of those classes). edges: pairs
    of representatives that connect what links connect.

    Bands with up to `crowded` documents propose pairs by a join. In a more
    crowded band all pairs are verified in blocks, without ever being rows.
    """
    bands, rows = choose_bands(similarity, recall)
    sig = stash(signatures(docs, bands, rows, n), "signatures")
    worded = sig.filter("size > 0")
    placed, told = equal_sets(worded)
    bare = stash(sig.filter("size = 0").select("doc_id"), "bare")
    chosen = told.select(F.col("representative").alias("doc_id"), "copies").distinct()
    first = worded.select("doc_id", "size", "bands").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    posted = stash(first.select("doc_id", "size", "copies", F.posexplode("bands").alias("pos", "band")), "posted")
    drop_stash(sig)
    crowds = stash(posted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams_in")).filter(F.col("n") > crowded), "crowds")
    inside = stash(posted.join(crowds, "band"), "inside")
    of_doc = inside.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "band")).alias("crowds"))  # at most one entry for each band

    few = posted.join(crowds, "band", "left_anti")
    a, b = few.select("band", F.col("doc_id").alias("a"), F.col("size").alias("size_a")), few.select("band", F.col("doc_id").alias("b"), F.col("size").alias("size_b"))
    # A pair below this ratio of sizes can't reach the threshold.
    near = (F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    pairs = stash(a.join(b, "band").filter(near).select("a", "b").distinct(), "pairs")
    drop_stash(posted, crowds)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(of_doc.select("doc_id")).distinct()
    # Ids grow with the documents, so this join is planned as a shuffle at every size.
    sets = stash(ngram_sets(docs.hint("merge").join(needed, "doc_id", "left_semi"), n).dropDuplicates(["doc_id"]), "sets")
    keys = of_doc.select("doc_id", F.transform("crowds", lambda x: x["band"]).alias("keys"))
    met = F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False))  # verified in a crowded band
    apart = pairs.join(keys.toDF("a", "keys_a"), "a", "left").join(keys.toDF("b", "keys_b"), "b", "left").filter(~met).select("a", "b")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    share = both / (F.size("grams_a") + F.size("grams_b") - both)
    links = apart.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b").select("a", "b", share.alias("similarity"))
    links = stash(links.filter(F.col("similarity") >= similarity).select("a", "b"), "links")

    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("grams_in") / BLOCK_GRAMS)).cast("int")
    spread = inside.withColumn("block", F.pmod(F.xxhash64("doc_id", "band"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("doc_id", "copies", "band", "pos", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    spread = spread.join(sets, "doc_id").join(of_doc, "doc_id")
    verified = spread.groupBy("band", "i", "j").applyInArrow(_crowd_links(similarity, bands), "representative long, others long, n_near long, root long")
    verified = stash(verified, "verified")
    drop_stash(inside, pairs, sets)

    ends = links.select(F.col("a").alias("representative"), F.col("b").alias("other")).union(links.select("b", "a"))
    beside = ends.join(chosen.toDF("other", "others"), "other").select("representative", "others", F.lit(1).cast("long").alias("n_near"))
    counts = beside.union(verified.select("representative", "others", "n_near")).groupBy("representative").agg(F.sum("others").alias("others"), F.sum("n_near").alias("n_near"))
    edges = links.union(verified.filter("root <> representative").select("representative", "root"))
    return placed, told, bare, counts, edges


def _classes(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(documents with their _key, what join_documents gives with keys in place of doc_id)."""
    keyed = row_keys(docs)
    placed, told, bare, counts, edges = similarities(keyed.select(F.col("_key").alias("doc_id"), "text"), **how)
    group = components(edges.toDF("a", "b")).withColumnRenamed("node", "representative")
    facts = told.join(counts, "representative", "left").join(group, "representative", "left")
    out = placed.join(facts, ["_part", *SET]).select(
        "doc_id",
        F.coalesce("component", "representative").alias("class_id"),
        "representative",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    zero = F.lit(0).cast("long")
    return keyed, out.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("representative"), zero.alias("n_links"), zero.alias("n_near")))


def join_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, representative, n_links, n_near of every document.

    class_id is the smallest doc_id that links lead to; n_links counts the
    other documents of at least the given similarity (copies included), n_near
    the different n-gram sets among them. A text of one to n-1 words has one
    shingle of all its words; null and wordless texts link to nothing and are
    classes of their own. Rows that repeat a doc_id with one text count as
    copies. Rows without a doc_id, or whose doc_id names several texts, take
    part by a key of their own (row_keys()), which comes after usual ids and is
    the class_id of a class without any. Extra columns are left out; an empty
    table gives an empty result.
    """
    keyed, out = _classes(docs, **how)
    # Only a key that row_keys() made differs from its doc_id.
    made = stash(keyed.filter(F.col("_key") >= ODD).select(F.col("_key").alias("doc_id"), F.col("doc_id").alias("own"), F.lit(True).alias("_made")).distinct(), "made")
    own = F.when(F.col("_made"), F.col("own")).otherwise(F.col("doc_id"))
    return out.join(made, "doc_id", "left").select(own.alias("doc_id"), "class_id", "representative", "n_links", "n_near")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents whose key (doc_id, see row_keys()) is the smallest of their class, all columns kept. Rows that repeat a doc_id and text stay together, as do those of one text without a doc_id."""
    keyed, out = _classes(docs, **how)
    kept = out.filter("doc_id = class_id").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.hint("merge").join(kept, "_key", "left_semi").select(*docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
