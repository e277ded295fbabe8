"""Ids against the library for tokenizers of several kinds; ranks of a frequent length."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

from photolake.llm import packing

LETTERS = "abcdefghijklmnoprstuwxyzABCDEFGHWé.,!?'-_<>| 0127"


def _bpe(split, normal=None, added=()):
    """A small byte-pair tokenizer that merges across capitals and punctuation."""
    merges = [("H", "e"), ("l", "l"), ("He", "ll"), ("h", "e"), ("o", "."), ("d", "!"), ("o", "!"), ("w", "o"), ("W", "o"), (",", "a"), ("e", "."), ("é", "!")]
    names = sorted(set(LETTERS) | {"\x01", "<unk>"}) + ["".join(m) for m in merges]
    tokenizer = Tokenizer(models.BPE({t: i for i, t in enumerate(names)}, merges, unk_token="<unk>"))
    tokenizer.pre_tokenizer = split
    if normal:
        tokenizer.normalizer = normal
    tokenizer.add_special_tokens([AddedToken(x, normalized=False) for x in added])
    return tokenizer


KINDS = {
    "given": None,
    "cased": lambda: _bpe(pre_tokenizers.WhitespaceSplit()),
    "joins punctuation": lambda: _bpe(pre_tokenizers.WhitespaceSplit(), normalizers.Lowercase()),
    "parts punctuation": lambda: _bpe(pre_tokenizers.BertPreTokenizer(), normalizers.Lowercase()),
    "added letters and punctuation": lambda: _bpe(pre_tokenizers.BertPreTokenizer(), normalizers.Lowercase(), ["lo!"]),
    "added with a space": lambda: _bpe(pre_tokenizers.WhitespaceSplit(), None, ["he wo"]),
    "no split": lambda: _bpe(pre_tokenizers.Split("\n", "isolated")),
}


@pytest.mark.parametrize("kind", KINDS)
def test_ids_are_the_library_ones(tmp_path, kind):
    path = packing.default_tokenizer()
    if KINDS[kind]:
        KINDS[kind]().save(path := str(tmp_path / "t.json"))
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(5)
    words = ["Hello", "World!", "hello.", "lo!", "HELLO", "he", "wo", "Wo,a", "<|endoftext|>", "d!!", "é!", "É!", "don't", "\x01", "x\x01y"]
    texts = ["", " ", "\n\t", "Hello World", "he wo  he\nwo"]
    for _ in range(400):
        texts.append("".join(r.choice(["".join(r.choices(LETTERS, k=r.randint(1, 8))), r.choice(words), " ", "\n", "  "]) for _ in range(r.randint(1, 12))))
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert (encoder.by_part, encoder.lowers, encoder.parts) == {"given": (True, True, True), "cased": (True, False, False), "joins punctuation": (True, True, False), "parts punctuation": (True, True, True), "added letters and punctuation": (True, True, False)}.get(kind, (False, False, False))


def test_a_frequent_length_is_packed_whole(spark):
    """Two thirds of the pieces have one length; places are those of best-fit decreasing."""
    r = random.Random(2)
    lengths = [1] * 4000 + [r.randint(1, 50) for _ in range(2000)]
    rows = [(i % 700, i, 0, n, i) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("x", F.lit("extra")).repartition(6)
    got = packing.pack(pieces, 50).toPandas()
    assert len(got) == len(rows) and sorted(got.piece) == list(range(len(rows)))
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 50
    plan = packing.best_fit_plan(collections.Counter(n for n in lengths if n < 50), 50)
    bins = int((plan[:, 3] + plan[:, 4]).max()) + sum(n == 50 for n in lengths)
    assert got.sequence_id.nunique() == bins
