"""Best-fit packing of token sequences into sequences of bounded length.

Best-fit decreasing only looks at lengths, and there are at most `capacity` of
those, so the exact packing of all pieces follows from the table of counts by
length. The driver plays it out over that table: pieces of one length are
placed together into bins with one history, which a segment tree over the
remaining capacities finds in logarithmic time. What comes back is a plan of at
most a few entries for each length, whatever the number of documents; tasks
then look up the place of each piece by its rank among those of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.textnum import chunks, text_array
from photolake.operators.ranks import rank_within
from photolake.session import stash, table, use_package

CAPACITY = 2048
#: Encoded words that a worker remembers; then it starts anew. Longer ones than LONG characters are not remembered.
REMEMBERED, LONG = 500_000, 64
#: Characters of new words that are encoded as one text; a longer word is a text of its own.
BLOCK_CHARS = 8192
#: Characters behind a word that no tokenizer of this kind merges with it.
TRAILING = ".,;:!?*#$%&@=+/|~^_-()[]{}<>\""


class CapacityTree:
    """Segment tree over remaining capacities 0..top; each leaf holds the groups of open bins with that much room."""

    def __init__(self, top: int):
        self.top = top
        self.size = 1 << top.bit_length()
        self.filled = [0] * (2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int, delta: int) -> None:
        i = room + self.size
        while i:
            self.filled[i] += delta
            i >>= 1

    def add(self, room: int, group: tuple[int, int]) -> None:
        self.groups.setdefault(room, []).append(group)
        self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._mark(room, -1)
        return self.groups[room].pop()

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least `need` that some open bin has."""
        i = need + self.size
        if self.filled[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.filled[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.filled[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, pieces a bin, first bin, bins, offset): of the pieces
    with that length, those from that rank on fill the bins one after the other.
    The same as placing pieces one by one, since pieces of one length are alike
    and a bin that has just taken one is the tightest as long as another fits.
    """
    tree, plan, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, open_bins = bins, -(-left // each)
                bins += open_bins
            else:
                first, open_bins = tree.take(room)
                each = room // length
            full = min(open_bins, left // each)
            if full:
                plan.append((length, rank, each, first, full, capacity - room))
                tree.add(room - each * length, (first, full))
                rank, left, first, open_bins = rank + full * each, left - full * each, first + full, open_bins - full
            if open_bins and left:  # fewer than `each` are left
                plan.append((length, rank, left, first, 1, capacity - room))
                tree.add(room - left * length, (first, 1))
                first, open_bins, left = first + 1, open_bins - 1, 0
            if open_bins:
                tree.add(room, (first, open_bins))
    return np.array(plan, np.int64).reshape(-1, 6)


#: Fixed value: the pattern of tokenizers that part words, single digits and runs of other characters.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _steps(of: dict | None, key: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences laid out."""
    if not of:
        return []
    return [x for own in of[key] for x in _steps(own, key)] if of["type"] == "Sequence" else [of]


def shortcuts(config: dict) -> tuple[bool, bool, bool]:
    """What a tokenizer's description proves: that parts between white space can be encoded alone, that Latin-1 capitals count as small letters, and that letters and TRAILING characters behind them are parted.

    Only known steps prove anything: white space is dropped by the first
    pre-tokenizer, no step before it looks at neighbours beyond combining marks,
    and no added token holds white space, takes some along or asks for word
    ends, or is letters with TRAILING characters behind.
    """
    normal, split = _steps(config["normalizer"], "normalizers"), _steps(config["pre_tokenizer"], "pretokenizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = all(x["type"] in ("NFC", "Lowercase") or x == spaces for x in normal)
    words = bool(split) and split[0]["type"] == "Split" and split[0]["pattern"] == {"Regex": WORD_SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    drops = words or (bool(split) and split[0]["type"] in ("BertPreTokenizer", "WhitespaceSplit"))
    added = config["added_tokens"] or []
    plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in added)
    straddles = any(re.fullmatch(rf"[^\W\d_]+[{re.escape(TRAILING)}]+", x["content"]) for x in added)
    by_part = known and drops and plain
    parted = words or (bool(split) and split[0]["type"] == "BertPreTokenizer")
    return by_part, by_part and any(x["type"] == "Lowercase" for x in normal), by_part and parted and not straddles


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit integers; words seen before come from memory.

    A tokenizer that drops white space and never merges across it gives the same
    ids for space-separated parts as for the whole text. New parts are encoded
    many to a text with MARK between them, a control character that becomes one
    token of its own, at which the ids are cut. Tokenizers whose description
    doesn't prove that (shortcuts()), and parts that hold MARK, get whole texts.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        a, mark, b = self._whole(["Ab.", self.MARK, "7c"])
        self.mark = int.from_bytes(mark, "little")
        proven, self.lowers, self.parts = shortcuts(json.loads(self.tokenizer.to_str()))
        self.by_part = proven and len(mark) == 4 and self._whole([f" Ab. {self.MARK}\n7c  ", f"Ab.\n\n 7c {self.MARK}\t", " \n"]) == [a + mark + b, a + b + mark, b""]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """New parts; of a Latin-1 word with punctuation behind it or with capitals, the bare word and the punctuation are encoded instead, where the tokenizer takes them so."""
        whole, pieces = [], []
        for p in parts:
            bare = p if p.isascii() or (p and max(p) < "\u0100") else ""
            bare = bare.lower() if self.lowers else bare
            bare = bare.rstrip(TRAILING) if self.parts else bare
            if bare != p and bare.isalpha():
                pieces.append((p, bare, p[len(bare) :]))
            else:
                whole.append(p)
        more = {x for _, *own in pieces for x in own}.difference(self.known, whole)
        self._encode_parts(whole + list(more))
        known = self.known
        for p, bare, tail in pieces:
            known[p] = known[bare] + known[tail]

    def _encode_parts(self, parts: list[str]) -> None:
        plain = [p for p in parts if self.MARK not in p]
        sizes = np.cumsum([len(p) + 3 for p in plain])
        cuts = np.searchsorted(sizes, np.arange(1, sizes[-1] // BLOCK_CHARS + 1) * BLOCK_CHARS, side="right").tolist() if plain else []
        blocks = [plain[a:b] for a, b in zip([0, *cuts], [*cuts, len(plain)], strict=True) if a < b]
        for block in blocks:
            raw = self._whole([f" {self.MARK} ".join(block)])[0]
            ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)).tolist()
            self.known.update(zip(block, (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)), strict=True))
        odd = [p for p in parts if self.MARK in p]
        self.known.update(zip(odd, self._whole(odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_part:
            return self._whole(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        self._learn(list(new))
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for p in new:
            if len(p) > LONG:
                del self.known[p]
        return out


@lru_cache(maxsize=4)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every document's tokens and an end token, cut into pieces only where longer than capacity.

    A null text counts as empty and gives the end token alone. Rows with one
    doc_id are documents of their own. Input columns other than doc_id and text
    are left out.
    """
    use_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encoder = end_id.to_bytes(4, "little"), _encoder(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, piece, start, length, crc = [], [], [], [], []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(text_array(part.column("text")).to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        doc.append(doc_id)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (length at most capacity), packed by best-fit decreasing over all of them.

    An empty table gives an empty result. Pieces that are equal in every column
    may change places with each other. pieces must give its rows in the same
    order whenever it is read, as a written table does: a piece that fills a
    sequence alone gets a negative number from its place there, without a rank.
    """
    spark = pieces.sparkSession
    use_package(spark)
    alone = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.filter(F.col("length") != capacity)
    # At most a row for each length, whatever the input.
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(histogram, capacity)
    # The plan is sorted by length and rank for the look-up.
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        # Ranks of different lengths don't overlap once each length has a range of its own.
        step = int(plan[:, 1].max()) + 1 if len(plan) else 1
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            row = np.searchsorted(plan[:, 0] * step + plan[:, 1], length * step + np.minimum(rank, step - 1), side="right") - 1
            _, lo, each, first, _, offset = plan[row].T
            nth = rank - lo
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first + nth // each), pa.array(offset + nth % each * length)], [*names, "sequence_id", "offset"])

    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank")  # over range partitions: a frequent length is spread
    kinds = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return alone.unionByName(ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents; the pieces are written once, as counting and placing both read them."""
    return pack(stash(token_pieces(docs, path, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
