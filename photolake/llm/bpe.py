"""Byte-pair encoding by a token automaton, and decoding by its arc labels.

The automaton reads tokens: an arc for token t leaves a state if t may follow
there. It starts as one state with an arc for every byte. Each merge (u, v) -> w,
in order, adds a gadget: after u the arc for v goes, and w gets an arc wherever
u has one, into the state that v's arc leads to. The state after a token depends
on that token alone, and many tokens share states and columns until a merge
tells them apart, so the transition table is kept as classes of states by
classes of tokens, copied only when a merge splits a class. In the finished
automaton exactly one path spells a given word, and it is the encoding.

Words are run through it in numpy, all new words of a batch side by side: a
double-array trie proposes the tokens that begin at a position, the table says
which of them may follow the state reached there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from photolake.llm.textnum import chunks, text_array
from photolake.session import table, use_package

#: The published pre-split pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and space-separated parts that a worker remembers; then it starts anew. Longer ones than LONG characters are not remembered.
REMEMBERED = 400_000
LONG = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """Tables of the automaton; see the module's text."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self._compile(merges)
        self._trie()

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        made = {w for _, _, w in merges}
        single = sum(x is not None and i not in made for i, x in enumerate(self.labels))
        allowed = np.ones((1024, 1024), np.uint8)  # grows as classes split
        state = [0] * len(self.labels)  # class of the state after a token
        column = [0] * len(self.labels)
        # State 0 is where a word begins; it never loses an arc, so it counts one user more.
        users, owners = [single + 1], [single]
        for u, v, w in merges:
            state[w] = state[v]  # the state that v leads to, as it was before u == v loses its arc
            users[state[w]] += 1
            if users[old := state[u]] > 1:
                users[old] -= 1
                state[u] = len(users)
                users.append(1)
                if len(users) > len(allowed):
                    allowed = np.pad(allowed, ((0, len(allowed) // 2), (0, 0)))
                allowed[state[u], : len(owners)] = allowed[old, : len(owners)]
            if owners[old := column[v]] > 1:
                owners[old] -= 1
                column[v] = len(owners)
                owners.append(1)
                if len(owners) > allowed.shape[1]:
                    allowed = np.pad(allowed, ((0, 0), (0, allowed.shape[1] // 2)))
                allowed[: len(users), column[v]] = allowed[: len(users), old]
            allowed[state[u], column[v]] = 0
            column[w] = column[u]
            owners[column[w]] += 1
        self.state, self.column = np.array(state, np.int32), np.array(column, np.int32)
        self.bits = np.packbits(allowed[: len(users), : len(owners)], axis=1)

    def _trie(self) -> None:
        """The double array: node x has the child base[x] + byte, if that slot's owner is x."""
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, label in enumerate(self.labels):
            if label is None:
                continue
            x = 0
            for b in label:
                y = children[x].get(b)
                if y is None:
                    y = children[x][b] = len(children)
                    children.append({})
                    token.append(-1)
                x = y
            token[x] = t
        size = 2 * len(children) + 1024
        start: dict[int, int] = {}
        base, owner, found = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        slot, free, width = {0: 0}, 1, 257
        taken[0] = 1
        for x in sorted(range(len(children)), key=lambda i: -len(children[i])):
            if not (own := sorted(children[x])):
                break
            if len(own) < width:  # look again from the start once the sets get smaller, then only onwards
                free, width = 1, len(own)
            at = max(free - own[0], 1)
            while any(taken[at + b] for b in own):
                at += 1
            free = at + own[0]
            for b in own:
                taken[at + b] = 1
                slot[children[x][b]] = at + b
            start[x] = at
        for x, kids in enumerate(children):
            for b, y in kids.items():
                base[slot[x]] = start[x]
                owner[start[x] + b] = slot[x]
                found[start[x] + b] = token[y]
        self.base, self.owner, self.token = base, owner, found

    def may_follow(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        col = self.column[token]
        return (self.bits[state, col >> 3] >> (7 - (col & 7)).astype(np.uint8)) & 1 == 1

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The one path through the automaton that spells each word, as little-endian 32-bit ids."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        a = int(np.searchsorted(sizes[order], 1))
        while a < len(words):
            # Words of like length share a matrix of about 2 MB.
            most = max(2 * int(sizes[order[a]]), 12)
            b = min(int(np.searchsorted(sizes[order], most, side="right")), a + max(1, (1 << 18) // most))
            own = order[a:b]
            for i, ids in zip(own.tolist(), self._encode_block([words[i] for i in own], sizes[own]), strict=True):
                out[i] = ids
            a = b
        return out

    def _encode_block(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        n, top = len(words), int(sizes.max())
        text = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in words), np.uint8).reshape(n, top)
        last = np.full((top + 1, n), -1, np.int32)  # token that ends here on the path, and where it begins
        begin = np.zeros((top + 1, n), np.int32)
        for i in range(top):
            who = np.flatnonzero((sizes > i) & ((last[i] >= 0) if i else True))
            state = self.state[last[i, who]] if i else np.zeros(len(who), np.int32)
            node = np.zeros(len(who), np.int32)
            for j in range(i, top):
                child = self.base[node] + text[who, j]
                ok = (self.owner[child] == node) & (sizes[who] > j)
                if not ok.any():
                    break
                who, node, state = who[ok], child[ok], state[ok]
                t = self.token[node]
                hit = t >= 0
                hit[hit] = self.may_follow(state[hit], t[hit])
                last[j + 1, who[hit]] = t[hit]
                begin[j + 1, who[hit]] = i
        at, lane = sizes.copy(), np.arange(n)
        back = []
        while (at > 0).any():
            t = np.where(at > 0, last[at, lane], -1)
            if ((t < 0) & (at > 0)).any():
                raise ValueError("a word has no path: the vocabulary lacks some byte")
            back.append(t)
            at = begin[at, lane]
        flat = np.stack(back[::-1], axis=1)
        counts = (flat >= 0).sum(axis=1)
        raw, ends = flat[flat >= 0].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def load_automaton(path: str) -> TokenAutomaton:
    """Compile a byte-level vocabulary file (the JSON of the tokenizers library)."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    vocab, letters = given["model"]["vocab"], byte_letters()
    specials = {x["content"]: x["id"] for x in given["added_tokens"]}
    labels: list[bytes | None] = [None] * (1 + max([*vocab.values(), *specials.values()]))
    for t, i in vocab.items():
        if t not in specials:
            labels[i] = bytes(letters[c] for c in t)
    merges = []
    for m in given["model"]["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    made = TokenAutomaton(labels, merges, specials)
    for t, i in specials.items():
        made.labels[i] = t.encode()
    return made


class TextEncoder:
    """Whole texts through the automaton, as little-endian 32-bit ids; what repeats is remembered."""

    def __init__(self, automaton: TokenAutomaton):
        import regex

        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        longest_first = sorted(automaton.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # by the part without the blank before it

    def _pre_split(self, text: str) -> list[str]:
        if text[1:].isalpha() and text[0] == " ":
            return [text]
        if text[-1] in ".," and text[1:-1].isalpha() and text[0] == " ":
            return [text[:-1], text[-1]]
        return self.split(text)

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        self.words.update(zip(new, self.automaton.encode([w.encode() for w in new]), strict=True))

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Texts without special tokens. A single blank between visible characters begins a word, so the parts between such blanks are looked up on their own."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        words, lookup = self.words, self.parts
        split = [s.split(" ") for s in segments]
        new = set(chain.from_iterable(split)).difference(lookup)
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        own = {p: self._pre_split(" " + p) for p in new - odd}
        first = [self.split(p[0]) for p in split]  # has no blank before it
        # Where space meets a blank, the whole text is split at once.
        whole = {i: self.split(segments[i]) for i, p in enumerate(split) if odd and not odd.isdisjoint(p)}
        self._learn(set(chain.from_iterable(chain(own.values(), first, whole.values()))))
        for p, found in own.items():
            lookup[p] = words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])
        out = []
        for i, (parts, begin) in enumerate(zip(split, first, strict=True)):
            if i in whole:
                out.append(b"".join(map(words.__getitem__, whole[i])))
            else:
                head = b"".join(map(words.__getitem__, begin))
                parts[0] = ""
                out.append(head + b"".join(map(lookup.__getitem__, parts[1:])))
        for known, fresh in ((lookup, own), (words, chain.from_iterable(chain(own.values(), first, whole.values())))):
            for p in [p for p in fresh if len(p) > LONG]:
                known.pop(p, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        specials = self.automaton.specials
        if not any(s in t for t in texts for s in specials):
            return self._segments(texts)
        cut = [[x for x in self.special.split(t) if x] for t in texts]
        plain = [x for own in cut for x in own if x not in specials]
        done = iter(self._segments(plain))
        return [b"".join([specials[x].to_bytes(4, "little") if x in specials else next(done) for x in own]) for own in cut]


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str, shared) -> TextEncoder:
    """The worker's encoder; its memory of words goes on from task to task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(shared.value)
    return _encoders[path]


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, the digests of the empty string.
    Columns other than doc_id and text are left out; repeated rows give repeated
    results. The automaton is compiled once and broadcast; its size follows the
    vocabulary, not the data.
    """
    spark = docs.sparkSession
    use_package(spark)
    shared = spark.sparkContext.broadcast(load_automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        decimal = [str(i) for i in range(len(encoder.automaton.labels))].__getitem__
        for batch in batches:
            for part in chunks(batch, "text"):
                n, digest, back = [], [], []
                for raw in encoder.encode(text_array(part.column("text")).to_pylist()):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(encoder.automaton.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """The token ids of each text as an array: doc_id, ids. Null texts give an empty array."""
    spark = docs.sparkSession
    use_package(spark)
    shared = spark.sparkContext.broadcast(load_automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        for batch in batches:
            for part in chunks(batch, "text"):
                got = encoder.encode(text_array(part.column("text")).to_pylist())
                begin = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), default_tokenizer())
