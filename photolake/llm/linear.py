"""Hashed n-gram indicators of whole texts, and linear models over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from photolake.llm.rules import duplicate_lines, repeated_words
from photolake.llm.textnum import Bytes, U, load, mix, words

#: Features: lower-cased words, word pairs, word beginnings, and the shapes of words.
BITS = 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)  # shape of a byte: lower, upper, digit, other
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1
for _b in range(256):
    if _CLASS[_b] == 0:
        _CLASS[_b] = min(_b, 127) % 120 + 4


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, as (indptr, index).

    Word unigrams (ASCII case folded), pairs of neighbouring words, the first 4
    and 5 bytes of each longer word, the shape of the last four bytes of each
    word, and steps of the shares of repeated word triples and lines. Presence
    only, so a long text is no louder than its content.
    """
    t = load(texts)
    as_written = words(t)
    folded = Bytes(_LOWER[t.buf], t.offsets)
    start, end, doc = as_written.start, as_written.end, as_written.doc
    h = folded.hash(start, end)
    size = end - start
    codes = [h]
    docs = [doc]
    if len(h) > 1:
        near = doc[1:] == doc[:-1]
        codes.append(mix(h[:-1][near] * U(0x2545F4914F6CDD1D) + h[1:][near] + U(1)))
        docs.append(doc[1:][near])
    for k in (4, 5):
        longer = size > k
        codes.append(mix(folded.hash(start[longer], start[longer] + k) + U(k)))
        docs.append(doc[longer])
    shape = Bytes(_CLASS[t.buf], t.offsets)
    codes.append(mix(shape.hash(np.maximum(start, end - 4), end) + U(99)))
    docs.append(doc)
    # Share of words in repeated three-word windows and of repeated lines, in steps.
    n = len(t.offsets) - 1
    lines, again = duplicate_lines(as_written)
    size = np.maximum(as_written.count, 1)
    for k, share in enumerate((repeated_words(as_written) * 16 // size, again * 16 // np.maximum(lines, 1))):
        codes.append(mix((share + 32 * k + 1000).astype(U)))
        docs.append(np.arange(n))
    key = np.concatenate(docs).astype(np.int64) << bits | (np.concatenate(codes) >> U(64 - bits)).astype(np.int64)
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits), key & ((1 << bits) - 1)


def row_sums(indptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[indptr[1:]] - total[indptr[:-1]]


def log_count_ratio(indptr: np.ndarray, index: np.ndarray, y: np.ndarray, width: int, alpha: float = 1.0) -> np.ndarray:
    """Log of the smoothed shares of a feature among positive and negative texts; exactly 0 for a feature seen in neither."""
    rows = np.repeat(y > 0, np.diff(indptr))
    pos = np.bincount(index[rows], minlength=width)
    neg = np.bincount(index[~rows], minlength=width)
    p, q = (pos + alpha) / max((y > 0).sum() + 2 * alpha, 1), (neg + alpha) / max((y <= 0).sum() + 2 * alpha, 1)
    return np.where(pos + neg > 0, np.log(p) - np.log(q), 0.0)


def dual_coordinate_descent(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, cost: float = 1.0, passes: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss solved in its dual, one example at a time; y is 1 or -1. Returns weights and intercept.

    Each step sets one dual variable to its best value within [0, cost of its
    class] and moves the weights along that example; the costs are balanced by class.
    """
    n = len(y)
    w, b = np.zeros(width), 0.0
    dual = np.zeros(n)
    each = np.where(y > 0, cost * n / (2 * max((y > 0).sum(), 1)), cost * n / (2 * max((y <= 0).sum(), 1)))
    q = row_sums(indptr, value**2) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(n):
            at = slice(indptr[i], indptr[i + 1])
            slope = y[i] * (value[at] @ w[index[at]] + b) - 1.0
            new = min(max(dual[i] - slope / q[i], 0.0), each[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[index[at]] += step * value[at]
                b += step
                worst = max(worst, abs(new - dual[i]) * q[i])
                dual[i] = new
        if worst < 1e-3:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities of y = 1, by Newton's method with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * margin).sum(), d.sum()])
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)
