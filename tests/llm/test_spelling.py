"""Spelling variants against a plain comparison of words."""

import collections
import random
import re
import zlib

import numpy as np

from photolake.llm import spelling

SF = "/root/testdata/sf0.001"


def _counts(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def _near(w, n, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return {x for x in out if x in n and x != w}


def _expected(rows):
    n = _counts(rows)
    letters = {c for w in n for c in w}
    near = {w: _near(w, n, letters) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(spelling.op12_spelling_variants(spark, SF)) == _expected(rows)


def _odd():
    r = random.Random(8)
    letters = "abÀé×ÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(500)]
    chain = ["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]  # forms of forms
    texts = [" ".join(r.choices(words, k=200)) for _ in range(60)]
    texts += [None, "", "Mixed-CASE Ünder_ÀB1cd " * 3, "x" * 70_000 + " " + "x" * 70_001 + " y", " ".join(w for k, w in enumerate(chain) for _ in range(400 * 3**k)), "bbbbb " * 40_000]
    texts += ["x" * 70_000 + " " + "x" * 70_001] * 3
    return [*enumerate(texts, 1), (None, "without number " * 5), (1, texts[0])]


def test_odd_documents(spark):
    rows = _odd()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS word", "1 AS n").repartition(7)
    got = _got(spelling.spelling_variants(df))
    short = {w: v for w, v in got.items() if len(w) < 100}
    expected = _expected([(i, re.sub("x{100,}", " ", t or "")) for i, t in rows])
    assert short == expected and any(v[0] and v[0] != v[1] for v in short.values())
    long = {w: v for w, v in got.items() if len(w) >= 100}
    n = {w: k for w, k in _counts(rows).items() if len(w) >= 100}
    assert {w: v[2] for w, v in long.items()} == n
    assert all(v[3] == sum(abs(len(w) - len(x)) == 1 for x in n) for w, v in long.items())
    assert spelling.spelling_variants(df.filter("1 = 0")).count() == 0


def test_nodes_stand_for_prefixes(spark):
    """Equal numbers for equal prefixes alone, however words are dealt out."""
    r = random.Random(6)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(600)} | {"a" * 40, "a" * 41 + "b"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = spelling.with_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word", "nodes").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(x.word for x in got) == words
    by_prefix, by_node = collections.defaultdict(set), collections.defaultdict(set)
    for x in got:
        for k, node in enumerate(x.nodes, 1):
            by_prefix[x.word[:k]].add(node)
            by_node[node].add(x.word[:k])
    assert all(len(v) == 1 for v in [*by_prefix.values(), *by_node.values()])
    own = [next(iter(by_prefix[w])) for w in words]
    assert own == sorted(own)


def test_shared():
    r = random.Random(7)
    for _ in range(500):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        k = spelling.shared(a, b)
        assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])
    nodes, used = spelling.number_nodes(["ab", "abc", "b"], np.zeros(0, np.int64), "", 0)
    assert [x.tolist() for x in nodes] == [[0, 1], [0, 1, 2], [3]] and used == 4
