"""Chat formatting by columnar byte assembly.

Turns of a conversation meet in one group; a task then computes the lengths of all headers and contents, their
cumulative offsets and the places to which they are scattered, and copies them into one preallocated buffer that
becomes the Arrow column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: <|im_start|>role\ncontent<|im_end|>\n. Fixed strings of the format.
START, END = "<|im_start|>", "<|im_end|>"


def escape(texts: pa.Array) -> pa.Array:
    """Puts one more backslash between < and | wherever only backslashes stand between them: no '<|' remains, and
    each text comes from one source alone."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def _escape_role(roles: pa.Array) -> pa.Array:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l")):
        roles = pc.replace_substring(roles, a, b)
    return roles


def _unescape_role(role: str) -> str:
    out, marks = [], iter(role)
    for c in marks:
        out.append({"n": "\n", "l": "<", "\\": "\\"}[next(marks)] if c == "\\" else c)
    return "".join(out)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray, loss_role: str = "assistant") -> tuple[pa.Array, pa.Array]:
    """Formatted conversations (binary) and their loss spans (list of byte begin, byte end) from turns in order;
    turns holds the number of turns of each conversation."""
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    counted = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False).astype(bool)
    start, middle, end = (np.frombuffer(x, np.uint8) for x in (START.encode(), b"\n", END.encode() + b"\n"))
    sources = [(start, None), _parts(_escape_role(roles)), (middle, None), _parts(escape(texts)), (end, None)]
    n = len(texts)
    lengths = np.stack([np.full(n, len(d)) if o is None else np.diff(o) for d, o in sources], axis=1) if n else np.zeros((0, 5), np.int64)
    offsets = np.r_[0, np.cumsum(lengths.ravel())].astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint8)
    for i, (data, own) in enumerate(sources):
        at = offsets[:-1].reshape(-1, 5)[:, i]
        if own is None:
            out[(at[:, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
        else:
            size = lengths[:, i]
            shift = np.repeat(at - own[:-1], size)
            source = np.arange(int(own[0]), int(own[-1])) if n else np.zeros(0, np.int64)
            out[source + shift] = data[own[0] : own[-1]]
    heads = np.r_[0, np.cumsum(turns)].astype(np.int64)
    begins = offsets[heads * 5]
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(turns), [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(out)])
    of = np.repeat(np.arange(len(turns)), turns)
    content = offsets[:-1].reshape(-1, 5)[:, 3] - begins[of]
    spans = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([content, content + lengths[:, 3]], axis=1)[counted].ravel()), 2) if n else pa.FixedSizeListArray.from_arrays(pa.array([], pa.int64()), 2)
    edges = np.r_[0, np.cumsum(counted)][heads]
    return formatted.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), spans.cast(pa.list_(pa.int64())))


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", run_rows: int = 512, bucket_rows: int = 500) -> DataFrame:
    """(id_col, formatted binary, loss array<array<long>>): one row per conversation, turns by turn_col.

    loss holds the byte spans [begin, end) of loss_role's contents. Control strings in texts and line ends in roles are
    escaped reversibly. Null texts and roles are empty; null turns come first; turns that tie are ordered by role and
    text; repeated rows are repeated turns; rows with a null id are one conversation. Other columns are not read.
    A conversation is one value of the result, so its turns meet in one task; before they travel, each task packs
    up to run_rows turns of a conversation that lie together into one row, so a conversation of very many turns
    moves as few rows."""
    rows = chats.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))

    def pack(batches):
        for batch in batches:
            ids = batch.column(0)
            key = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, pc.fill_null(ids, 0).to_numpy())
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            cut = np.unique(np.concatenate([np.arange(a, b, run_rows) for a, b in zip(cut, np.r_[cut[1:], len(key)], strict=True)])) if len(key) else cut
            turns = pa.StructArray.from_arrays([pc.fill_null(batch.column(i), "") if i > 1 else batch.column(i) for i in (1, 2, 3)], ["turn", "role", "text"])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cut)), pa.ListArray.from_arrays(pa.array(np.r_[cut, len(key)].astype(np.int32)), turns)], ["id", "turns"])

    # all conversations of one bucket are assembled together: buckets, not conversations, are the groups
    n_buckets = F.lit(max(1, -(-rows.count() // bucket_rows)))
    packed = rows.mapInArrow(pack, "id long, turns array<struct<turn:long,role:string,text:string>>").withColumn("bucket", F.pmod(F.xxhash64("id"), n_buckets))

    def join_up(table: pa.Table) -> pa.Table:
        runs = table["turns"].combine_chunks()
        runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
        ids = table["id"].combine_chunks()
        owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        turn = pa.table({"id": ids.take(pa.array(owner)), "turn": flat.field("turn"), "role": flat.field("role"), "text": flat.field("text")})
        turn = turn.take(pc.sort_indices(turn, sort_keys=[("id", "ascending"), ("turn", "ascending"), ("role", "ascending"), ("text", "ascending")], null_placement="at_start")).combine_chunks()
        ids = turn["id"].combine_chunks()
        key = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, pc.fill_null(ids, 0).to_numpy())
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        formatted, loss = assemble(turn["role"].combine_chunks(), turn["text"].combine_chunks(), np.diff(np.r_[cut, len(key)]), loss_role)
        return pa.table([ids.take(pa.array(cut)), formatted, loss], names=[id_col, "formatted", "loss"])

    return packed.groupBy("bucket").applyInArrow(join_up, f"`{id_col}` long, formatted binary, loss array<array<long>>")


def parse_chat(formatted: bytes) -> list[tuple[str, str]]:
    """The (role, text) turns of one formatted conversation."""
    turns, text = [], formatted.decode()
    at, head = 0, len(START)
    contents = []
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(END, line)
        turns.append(_unescape_role(text[at + head : line]))
        contents.append(text[line + 1 : stop])
        at = stop + len(END) + 1
    return list(zip(turns, unescape(pa.array(contents, pa.string())).to_pylist(), strict=True))


def chat_digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What format_chats returns, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            out: list = []
            for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_chat(formatted)
                every = "".join(f"{role}\n{text}\n" for role, text in turns)
                masked = "".join(unescape(pa.array([formatted[a:b].decode() for a, b in loss], pa.string())).to_pylist())
                out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted.decode())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, f"`{id_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
