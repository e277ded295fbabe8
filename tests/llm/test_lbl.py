"""Language-model scores: counts and base scores by brute force, probabilities that sum to one, held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from photolake.llm import lbl

SF = "/root/testdata/sf0.001"


def _tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def _base(rows):
    c = collections.Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(_tokens(text))
    total = sum(c.values())
    out = {}
    for i, text in rows:
        t = _tokens(text)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in t)
        out[i, len(t)] = (held, sum(c[x] > 0 for x in t), total, pytest.approx(base, rel=1e-9, abs=1e-9))
    return out


def _got(rows):
    return {(r.doc_id, r.n_tokens): (r.held_out, r.n_known, r.train_tokens, r.base_score) for r in rows}


def _odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One TWO Ünder one"), (5, "one"), (5, "one two"), (None, "no number here"), (6, "é</s> 日本 x " * 9000), (7, "never seen before " * 50), *((i, f"word{i % 7} the word{i % 3} of a") for i in range(10, 80))]
    rows.append(rows[-1])
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS h", "'x' AS held_out").repartition(5)


@pytest.mark.parametrize("held", [0, 6, lbl.HELD])
def test_odd_documents(spark, monkeypatch, held):
    """However many words' counts are held, the others' are joined: results are the same."""
    rows, df = _odd(spark)
    monkeypatch.setattr(lbl, "HELD", held)
    found = lbl.language_model_scores(df).collect()
    assert len(found) == len(rows) and _got(found) == _base(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_tail_gives_the_same_scores(spark, monkeypatch):
    """With frequent words alone held, scores are those with all words held."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lbl.language_model_scores(docs).collect()}
    monkeypatch.setattr(lbl, "HELD", 3000)  # above WORDS, so that the items stay
    part = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lbl.language_model_scores(docs).collect()}
    assert part.keys() == whole.keys() and all(part[k] == pytest.approx(whole[k], rel=1e-9) for k in whole)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(lbl.op11_lm_scoring(spark, SF).collect()) == _base(rows)


def test_held_out_texts_are_likelier_than_by_frequency(spark):
    found = lbl.op11_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert (found.score > found.base_score).mean() > 0.95
    assert found.score.sum() / found.n_tokens.sum() > found.base_score.sum() / found.n_tokens.sum() + 0.25


def test_probabilities_sum_to_one(spark):
    """Over all items, and over all words of a group and the unseen one."""
    counted = lbl.count_words(spark.read.parquet(f"{SF}/documents.parquet"))
    known = lbl.vocabulary(counted)
    r = np.random.default_rng(1)
    model = lbl.train(r.poisson(0.05, (lbl.ITEMS, lbl.ITEMS)).astype(float), 20)
    assert np.allclose((10 ** model.log10_probabilities()).sum(axis=1), 1)
    own = set(known.item_hash.tolist())
    left = counted.filter(f"g <> {lbl.NO_GROUP}").toPandas()
    left = left[~left.h.isin(own)]
    share = np.bincount(left.g, left.c + 0.5, lbl.GROUPS) + 0.5
    assert np.allclose(share, known.group_total + 0.5 * (known.group_distinct + 1))
    assert len(own) == lbl.WORDS + 1


def test_noise_contrast_finds_conditional_frequencies():
    """With enough pairs the normalised model comes near the relative frequencies."""
    r = np.random.default_rng(3)
    n = 60
    true = r.dirichlet(np.full(n, 0.5), 4)[np.arange(n) % 4]
    pairs = r.multinomial(20_000, true)
    model = lbl.train(pairs.astype(float), 400)
    p = 10 ** model.log10_probabilities()
    assert (true * np.log(true / np.maximum(p, 1e-12) + 1e-300)).sum(axis=1).mean() < 0.05


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lbl.language_model_scores(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = lbl.language_model_scores(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone] == [(4, 0, 0, 0.0)] and alone[0].score < 0
