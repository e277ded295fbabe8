"""Each stage of the pipeline on what its predecessor kept, row by row against brute force, and run() as a whole."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from photolake.llm import packing, quality, rules
from tests.llm.test_corpus import SF, WORD, _jaccard


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _odd(spark):
    """The given documents, and rows without id or text, empty, repeated and very long ones, with columns of clashing names."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    some = given.filter("n_chars between 400 and 3000").orderBy("doc_id").limit(60).collect()
    long = " ".join(r.text for r in some[5:] if r.doc_id % 2)
    extra = [(None, some[0].text + " more"), (None, None), (9001, None), (9002, ""), (9003, " \n\t "), (9004, long * 3), (9005, long), (9006, some[1].text), (9007, some[2].text + " changed a little"), tuple(some[3][:2])]
    more = spark.createDataFrame([(i, t, "en", "srcx", len(t or "")) for i, t in extra], given.schema)
    return given.unionByName(more).withColumn("score", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("_key", F.lit(2)).repartition(5)


@pytest.fixture(scope="module", params=["given", "odd"])
def steps(spark, request, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    sf = SF
    if request.param == "odd":
        sf = str(base / "in")
        _odd(spark).write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return sf, out


def test_columns_stay(steps):
    _, out = steps
    assert all(df.columns == out[0].columns for df in out[:5])


def test_quality_classifier(spark, steps):
    sf, (before, after, *_) = steps
    score = collections.defaultdict(set)
    for r in quality.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).collect():
        score[r.doc_id].add(r.predicted)
    had, kept = collections.Counter(_rows(before)), collections.Counter(_rows(after))
    for row, n in had.items():
        if len(score[row[0]]) == 1:
            assert kept[row] == n * (1 in score[row[0]])
    assert not kept - had and 20 < sum(kept.values()) < sum(had.values())


def test_quality_rules(steps):
    _, (_, before, after, *_) = steps
    judged = {r.doc_id: r.kept for r in rules.weak_supervision(before.filter("doc_id is not null")).collect()}
    had, kept = collections.Counter(_rows(before)), collections.Counter(_rows(after))
    for row, n in had.items():
        if row[0] is not None:
            assert kept[row] == n * judged[row[0]]
    assert not kept - had and kept and all(len(WORD.findall(t or "")) >= 50 for _, t in kept)


def test_ngram_jaccard_join(steps):
    _, (_, _, before, after, *_) = steps
    rows = sorted(set(_rows(before)), key=lambda r: (r[0] is None, r[0] or 0))
    texts = {i: t or "" for i, (_, t) in enumerate(rows)}
    group = {i: i for i in texts}
    links = _jaccard(texts)
    for _ in rows:
        moved = False
        for a, b in links:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
        if not moved:
            break
    assert set(_rows(after)) == {rows[i] for i in set(group.values())} and len(set(group.values())) < len(rows)


def test_suffix_array_dedup(steps):
    _, (_, _, _, before, after, _) = steps
    rows = sorted(set(_rows(before)), key=lambda r: (r[0] is None, r[0] or 0))
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = collections.Counter()
    for i, ((doc_id, _), w) in enumerate(zip(rows, words, strict=True)):
        cut = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        if left := " ".join(x for j, x in enumerate(w) if j not in cut):
            want[doc_id, left] += 1
    got = collections.Counter((i, " ".join(WORD.findall(t or ""))) for i, t in set(_rows(after)))
    assert got == want


def test_best_fit_packing(spark, steps):
    sf, (*_, before, after) = steps
    library = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for doc_id, text in _rows(before):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a : a + 2048]
            want[doc_id, piece, a, len(own), zlib.crc32(own.tobytes())] += 1
    rows = after.toPandas()
    got = collections.Counter((None if i != i else int(i), *map(int, x)) for i, *x in zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True))
    assert got == want
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collections.Counter(map(tuple, whole.select(*key).collect())) == want and whole.select("sequence_id").distinct().count() == rows.sequence_id.nunique()
