"""Chat formatting by columnar byte assembly.

All turns of an Arrow batch are laid out at once: numpy works out the length of
every segment (marks, role, text), cumulative sums give each its place, and
index arrays scatter headers and texts into one buffer. Control strings inside
roles and texts get a backslash after their first character, backslashes are
doubled, so marks in the output are always the template's own and the original
can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.textnum import chunks, text_array
from photolake.session import table, use_package

#: The template: BEGIN role MIDDLE text END, turn after turn.
BEGIN, MIDDLE, END = b"[INST]", b"[/INST]", b"</s>"
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
LEARNT_ROLE = b"assistant"


def escape(texts: pa.Array) -> pa.Array:
    """Texts in which no control string is left; unescape() undoes it."""
    doubled = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring_regex(doubled, r"(<|\[)(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")", r"\1\\\2")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S) if b"\\" in text else text


def _raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted: (bytes, start of each turn and the end, loss mask as [start, end] of learnt texts)."""
    marks = [np.frombuffer(m, np.uint8) for m in (BEGIN, MIDDLE, END)]
    (role, role_at), (text, text_at) = _raw(escape(roles)), _raw(escape(texts))
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = [len(m) for m in marks]
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    place = np.concatenate([[0], np.cumsum(lengths.ravel())])
    start = place[:-1].reshape(n, 5)
    out = np.empty(place[-1], np.uint8)
    for k, m in zip((0, 2, 4), marks, strict=True):
        out[(start[:, k, None] + np.arange(len(m))).ravel()] = np.tile(m, n)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        out[np.arange(len(data)) + np.repeat(start[:, k] - at[:-1], np.diff(at))] = data
    learnt = pc.equal(roles, LEARNT_ROLE.decode()).to_numpy(zero_copy_only=False)
    return out, np.append(start[:, 0], place[-1]), np.column_stack([start[learnt, 3], start[learnt, 4]])


def code_points(data: bytes) -> int:
    raw = np.frombuffer(data, np.uint8)
    return int(((raw & 0xC0) != 0x80).sum())


def _ordered(turns: DataFrame) -> DataFrame:
    """Conversations kept together and in order; sorting spills, so a conversation may be of any length."""
    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded text, since index arrays take several times the bytes of a text."""
    for b in batches:
        yield from chunks(b, "text")


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted turns in order: conv_id, turn, formatted, loss_start, loss_end (code points within formatted, null if not learnt).

    A conversation's text is its turns' end to end. A null text or role counts
    as empty, turns come in order of turn (null first), then role and text;
    repeated rows are turns of their own. Extra columns are left out.
    """
    use_package(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out, start, spans = assemble(text_array(b.column("role")), text_array(b.column("text")))
            made = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(out))
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            at = np.searchsorted(start, spans[:, 0], side="right") - 1
            lo, hi = np.full(b.num_rows, -1), np.full(b.num_rows, -1)
            lo[at], hi[at] = points[spans[:, 0]] - points[start[at]], points[spans[:, 1]] - points[start[at]]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), made, pa.array(lo, mask=lo < 0), pa.array(hi, mask=hi < 0)], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return _ordered(turns).mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def chat_digests(turns: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    Turns come sorted and are digested as they pass, so memory doesn't follow
    the length of a conversation. An empty table gives an empty result.
    """
    use_package(turns.sparkSession)
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state is not None:
                done.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in kind.split(", ")])

        for b in _slices(batches):
            out, start, spans = assemble(text_array(b.column("role")), text_array(b.column("text")))
            data = out.tobytes()
            ids = b.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else []
            span = 0
            for a, z in zip(cuts, cuts[1:], strict=False):
                if state is None or state["id"] != ids[a]:
                    close()
                    state = {"id": ids[a], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                lo, hi = start[a], start[z]
                text = data[lo:hi]
                state["formatted"] += code_points(text)
                for turn in text.split(END)[:-1]:
                    role, _, said = turn[len(BEGIN) :].partition(MIDDLE)
                    state["n"] += 1
                    state["turns"].update(unescape(role) + b"\n" + unescape(said) + b"\n")
                while span < len(spans) and spans[span, 0] < hi:
                    learnt = unescape(data[spans[span, 0] : spans[span, 1]])
                    state["chars"] += code_points(learnt)
                    state["loss"].update(learnt)
                    span += 1
            yield flush()
        close()
        yield flush()

    return _ordered(turns).mapInArrow(run, kind)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(turns.unionByName(probe))
