"""Quality rules under weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Nobody says
which rules are right: expectation-maximisation finds, from how often they
agree, each rule's accuracy on good and on bad documents and the share of good
ones, and a document is kept if the posterior probability of "good" is high
enough. Documents with equal votes are alike to the model, so it is fitted on
the exact counts of all vote patterns, of which there are at most 3**rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from photolake.llm.textnum import U, Words, chunks, load, mix, per_text, shingles, words
from photolake.session import stash, table, use_package

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
MIN_WORDS = 50
PRIOR = 0.02
FALSE_ALARM = 0.02
MAX_REPEATED = 50  # of 100 words


def of_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal keys of one text, so that one sort serves all texts."""
    return mix(keys ^ mix(doc.astype(U) + U(1)))


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each text."""
    own = of_text(keys, doc)
    order = np.argsort(own)
    k = own[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return np.bincount(doc[order[new]], minlength=n)


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Number of words of each text that lie in an n-word window found twice or more in that text."""
    h, at = shingles(w, n, whole_if_short=False)
    own = of_text(h, w.doc[at])
    order = np.argsort(own)
    k = own[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, w.first)


def duplicate_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines (split at \\n) with a word, and those of them equal to an earlier line of the text."""
    t = w.text
    n = len(t.offsets) - 1
    breaks = np.flatnonzero(t.buf == 10)
    start = np.concatenate([t.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, t.offsets[1:]])
    start, end = np.sort(start, kind="stable"), np.sort(end, kind="stable")
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(t.offsets, start, side="right") - 1
    lines = np.bincount(doc, minlength=n)
    return lines, lines - _distinct(t.hash(start, end), doc, n)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the rules look at, one entry a text."""
    t = load(texts)
    w = words(t)
    n = len(t.offsets) - 1
    inside = np.zeros(len(t.buf) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end[w.end < len(t.buf)]] -= 1
    visible = np.cumsum(inside[:-1]) > 0
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    lines, again = duplicate_lines(w)
    closing = np.zeros(256, bool)
    closing[list(b".!?:;\"')")] = True
    ends = np.zeros(len(w.hash), bool)
    if len(w.hash):
        ends = np.isin(t.buf[w.end - 1], np.flatnonzero(closing))
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": per_text(visible & ((t.buf & 0xC0) != 0x80), t.offsets),
        "n_symbols": per_text(SYMBOLS[t.buf], t.offsets),
        "n_dup_lines": again.astype(np.int64),
        "n_repeat_words": repeated_words(w),
        "n_lines": lines.astype(np.int64),
        "n_letters": per_text(letter[t.buf] & ((t.buf & 0xC0) != 0x80), t.offsets),
        "n_upper": per_text(upper[t.buf], t.offsets),
        "n_exclaims": per_text(t.buf == 33, t.offsets),
        "n_distinct": _distinct(w.hash, w.doc, n).astype(np.int64),
        "n_ends": per_text(ends, w.first),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaims", "n_distinct", "n_ends")


def with_measures(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The counts of every whole text beside the carried columns (doc_id alone unless told otherwise); a null text has no words."""
    use_package(docs.sparkSession)
    carry = ["doc_id"] if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(got[k]) for k in MEASURES)], [*carry, *MEASURES])

    kind = StructType([*(docs.schema[c] for c in carry), *(StructField(k, LongType()) for k in MEASURES)])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, kind)


def _rule(good, bad):
    return F.when(good, 1).when(bad, 0).otherwise(-1)


def default_rules() -> dict[str, Column]:
    """Each rule's vote as a column over the measures: 1 good, 0 bad, -1 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    c = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "symbols": _rule(F.col("n_symbols") * 50 < n, F.col("n_symbols") * 10 > n),
        "repeats": _rule(F.col("n_repeat_words") * 10 < n, F.col("n_repeat_words") * 10 > 3 * n),
        "dup_lines": _rule(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 10 > 3 * F.greatest(F.col("n_lines"), F.lit(1))),
        "letters": _rule(F.col("n_letters") * 100 > 88 * c, F.col("n_letters") * 100 < 75 * c),
        "upper": _rule(F.col("n_upper") * 100 < 15 * c, F.col("n_upper") * 100 > 40 * c),
        "exclaims": _rule(F.col("n_exclaims") * 100 < 5 * n, F.col("n_exclaims") * 100 > 30 * n),
        "word_length": _rule(mean.between(3.0, 10.0), (mean < 2.0) | (mean > 14.0)),
        "variety": _rule(F.col("n_distinct") * 100 > 35 * n, F.col("n_distinct") * 100 < 15 * n),
        "length": _rule(n >= 2 * MIN_WORDS, n < MIN_WORDS),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior_good: float = 0.8) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns: share of good documents, and P(vote | class) as [rule, class, vote + 1].

    Starts from every rule being mostly right, which fixes which class is "good".
    Pseudo-counts of PRIOR of the documents hold each rule near that start where
    the data say little, and no rule may be taken to condemn more than
    FALSE_ALARM of the good documents.
    """
    start = np.empty((patterns.shape[1], 2, 3))
    start[:, 1] = [0.25, 0.01, 0.74]  # abstains, bad, good
    start[:, 0] = [0.25, 0.25, 0.5]
    share, table_ = prior_good, start
    total = counts.sum()
    for _ in range(rounds):
        p = posterior(patterns, share, table_)
        weight = np.stack([(1 - p) * counts, p * counts])
        new = np.stack([(weight @ (patterns == v - 1)).T for v in range(3)], axis=2) + PRIOR * total * start
        new /= new.sum(axis=2, keepdims=True)
        over = np.maximum(new[:, 1, 1] - FALSE_ALARM, 0)
        new[:, 1, 1] -= over
        new[:, 1, 2] += over
        moved = abs(new - table_).max()
        table_ = new
        share = (weight[1].sum() + PRIOR * total * prior_good) / (total * (1 + PRIOR))
        if moved < 1e-9:
            break
    return float(share), table_


def posterior(patterns: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    score = np.full(len(patterns), np.log(share) - np.log(1 - share))
    for j in range(patterns.shape[1]):
        v = patterns[:, j] + 1
        score += np.log(table_[j, 1, v]) - np.log(table_[j, 0, v])
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words)"


def _learn(voted: DataFrame, votes: list[str]) -> Column:
    """Log odds that a document is good, as a column over its votes."""
    # What fails outright needs no votes; left in, it would make repetition the only thing that "bad" stands for.
    found = voted.filter(f"not {FAILED}").groupBy(*votes).count().collect()  # at most 3**rules rows
    patterns = np.array([[r[v] for v in votes] for r in found], np.int64).reshape(-1, len(votes))
    counts = np.array([r["count"] for r in found], float)
    share, learned = fit_votes(patterns, counts) if len(found) else (0.5, np.full((len(votes), 2, 3), 1 / 3))
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for j, v in enumerate(votes):
        ratio = np.log(learned[j, 1]) - np.log(learned[j, 0])
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in ratio)), F.col(v).cast("int") + 2)
    return odds


def _judge(voted: DataFrame, odds: Column, keep_from: float) -> DataFrame:
    judged = voted.withColumn("base_failed", F.expr(FAILED)).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def _vote(measured: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return measured.select("*", *(v.cast("byte").alias(f"vote_{k}") for k, v in rules.items()))


def weak_supervision(docs: DataFrame, rules: dict[str, Column] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, votes, posterior and verdict of every document.

    base_failed documents (under 50 words, or more than half their words in
    repeated three-word windows) are never kept. A null or empty text has no
    words and fails. Rows are judged one by one, so repeated rows get equal
    results; columns other than doc_id and text are left out. An empty table
    gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    voted = stash(_vote(with_measures(docs), rules), "votes")
    return _judge(voted, _learn(voted, [f"vote_{k}" for k in rules]), keep_from)


def keep_good(docs: DataFrame, rules: dict[str, Column] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that weak_supervision() keeps, all columns. Texts are measured twice rather than shuffled."""
    rules = default_rules() if rules is None else rules
    odds = _learn(_vote(with_measures(docs), rules), [f"vote_{k}" for k in rules])
    taken = {f"_in_{i}": c for i, c in enumerate(docs.columns)}  # input columns may be named like a measure
    inner = docs.select(*(F.col(c).alias(k) for k, c in taken.items()), "text")
    judged = _judge(_vote(with_measures(inner, list(taken)), rules), odds, keep_from)
    return judged.filter("kept").select(*(F.col(k).alias(c) for k, c in taken.items()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_supervision(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
