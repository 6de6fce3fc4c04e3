"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Tasks cut texts into pre-tokens and keep their positions as numbers into a block's own word list; only words travel,
one row (block, shard, words) for each shard of words' hashes. A shard is sorted together, so each distinct word of the
corpus is encoded once; its ids are joined back to all blocks that hold it, and each block puts its texts together
again by position. A block has one row a shard however often a word occurs, so no word is hot. Decoding is a join
with the token-byte table, whose size is the vocabulary's; it is broadcast.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, planes, unplanes, written

#: Characters of text per block.
BLOCK = 16_000_000
#: Shards of words' hashes, at least; twice the shuffle partitions where these are more. Fewer compress better.
SHARDS = 64
#: Bytes of words and ids that a task remembers; a shard with more distinct words has some of them encoded again.
HELD = 64_000_000
#: Numbers that one numpy pass handles: its temporaries stay small beside a block's own arrays, which are of 32 bits where they can be.
SLICE = 1 << 18
#: Numbers below LOW have a class of their own, those below MIDDLE share one by their high byte, those below HIGH by two.
LOW, MIDDLE, HIGH = 160, 160 + (64 << 8), 160 + (64 << 8) + (31 << 16)
#: White_Space of Unicode, as \s of the pattern means it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class _Numbers(dict):
    """Numbers keys in the order in which they are asked for first."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PreTokens:
    """Cuts texts by the pattern. Every match lies inside one run of ' ?\\S+' or is white space, so a run is
    cut once and then known by its number."""

    def __init__(self, pattern: str):
        self.runs = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.pieces = regex.compile(own)
        self.reset()

    def reset(self) -> None:
        self.known, self.texts, self.chars = _Numbers(), [], 0

    def add(self, text: str) -> None:
        self.texts.append(np.fromiter(map(self.known.__getitem__, self.runs.findall(text)), np.int32))
        self.chars += len(text)

    def block(self, shards: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words by falling count, then shard, then spelling; their shards; pre-tokens per text; and all pre-tokens as word numbers.
        The texts are used up."""
        words, slots, counts = _Numbers(), [], []
        for run in self.known:
            found = self.pieces.findall(run)
            slots.extend(map(words.__getitem__, found))
            counts.append(len(found))
        slots, counts = np.array(slots, np.int32), np.array(counts, np.int64)
        edges = np.r_[0, np.cumsum([len(t) for t in self.texts])].astype(np.int64)
        runs = np.concatenate(self.texts) if self.texts else np.zeros(0, np.int32)
        self.reset()
        flat, ends = _gathered(slots, np.cumsum(counts) - counts, counts, runs)
        per_text = np.diff(ends[edges])
        del runs, ends
        names = sorted(words)
        old = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
        shard = np.fromiter((zlib.crc32(w.encode()) % shards for w in names), np.int64, len(names))
        order = np.lexsort((shard, -np.bincount(flat, minlength=len(words))[old]))
        rank = np.empty(len(order), np.int32)
        rank[old[order]] = np.arange(len(order))
        return [names[i] for i in order], shard[order], per_text, rank[flat]


def _gathered(values: np.ndarray, begins: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches values[begins[i] : begins[i] + counts[i]] of all i in which, end to end, and their edges, 0 included."""
    total = sum(int(counts[which[a : a + SLICE]].sum()) for a in range(0, len(which), SLICE))
    out, edges = np.empty(total, values.dtype), np.zeros(len(which) + 1, np.int32 if total < 1 << 31 else np.int64)
    for a in range(0, len(which), SLICE):
        some = which[a : a + SLICE]
        n, b = counts[some], a + len(some)
        ends = int(edges[a]) + np.cumsum(n)
        edges[a + 1 : b + 1] = ends
        out[edges[a] : edges[b]] = values[np.repeat(begins[some] - (ends - n), n) + np.arange(edges[a], edges[b])]
    return out, edges


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1


def _packed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(pack: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(pack):
        n = int.from_bytes(pack[at : at + 8], "little")
        parts.append(pack[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _spread(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _classed(values: np.ndarray) -> tuple[bytes, ...]:
    kind = np.where(values < LOW, values, np.where(values < MIDDLE, LOW + ((values - LOW) >> 8), np.where(values < HIGH, 224 + ((values - MIDDLE) >> 16), 255)))
    near, far, wide = (kind >= LOW) & (kind < 224), (kind >= 224) & (kind < 255), kind == 255
    low, rest = (values[near] - LOW) & 255, (values[far] - MIDDLE) & 65535
    return tuple(x.tobytes() for x in (kind.astype(np.uint8), low.astype(np.uint8), (rest & 255).astype(np.uint8), (rest >> 8).astype(np.uint8), values[wide].astype("<i8")))


def _numbers(values: np.ndarray) -> bytes:
    """Numbers of which small ones are common: a byte of class each, and what the class leaves open apart."""
    parts = [_classed(values[a : a + SLICE]) for a in range(0, max(1, len(values)), SLICE)]
    return _packed([_squeezed(b"".join(p)) for p in zip(*parts, strict=True)])


def _unnumbers(packed: bytes) -> np.ndarray:
    kind, low, rest, rest_high, wide = map(_spread, _parts(packed))
    kind, wide = np.frombuffer(kind, np.uint8), np.frombuffer(wide, "<i8")
    values = kind.astype(np.int32 if wide.max(initial=0) < 1 << 31 else np.int64)
    near, far, huge = (kind >= LOW) & (kind < 224), (kind >= 224) & (kind < 255), kind == 255
    values[near] = LOW + ((values[near] - LOW) << 8) + np.frombuffer(low, np.uint8)
    values[far] = MIDDLE + ((values[far] - 224) << 16) + (np.frombuffer(rest_high, np.uint8).astype(np.int32) << 8) + np.frombuffer(rest, np.uint8)
    values[huge] = wide
    return values


def _listed(items: list[bytes]) -> bytes:
    """Byte strings as one, with their lengths."""
    lengths = np.array([len(x) for x in items], np.int64)
    return _packed([planes(lengths, _width(lengths)), _squeezed(b"".join(items))])


def _unlisted(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and all bytes of what _listed packed."""
    lengths, data = _parts(packed)
    return unplanes(lengths).astype(np.int64), _spread(data)


def _blocks(docs: DataFrame, pattern: str, size: int, shards: int) -> DataFrame:
    """Rows (block, shard, pack): the words of a block in a shard, and under a null shard its positions."""

    def run(batches):
        from pyspark import TaskContext

        task, made, cut = TaskContext.get().partitionId(), 0, PreTokens(pattern)
        ids: list[tuple] = []

        def rows_of(block, shard, packs):
            return pa.RecordBatch.from_arrays([pa.array([block] * len(packs), pa.int64()), pa.array(shard, pa.int32()), binary_array(packs)], ["block", "shard", "pack"])

        def flush():
            nonlocal made, ids
            block, made = (task << 32) + made, made + 1
            words, shard, per_text, flat = cut.block(shards)
            columns = [pa.array(c, pa.int64()) for c in zip(*ids, strict=True)]
            known = np.concatenate([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
            names = np.concatenate([c.fill_null(0).to_numpy() for c in columns])
            yield rows_of(block, [None], [_packed([known.tobytes(), names.tobytes(), planes(per_text, 4), _numbers(flat), planes(shard, _width(shard))])])
            order = np.argsort(shard, kind="stable")
            held, begins = np.unique(shard[order], return_index=True)
            edges = [*begins.tolist(), len(order)]
            for at in range(0, len(held), 64):
                some = range(at, min(at + 64, len(held)))
                yield rows_of(block, held[at : at + 64].astype(np.int32), [_listed([words[i].encode() for i in order[edges[k] : edges[k + 1]]]) for k in some])
            ids = []

        for batch in batches:
            for *i, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
                ids.append(tuple(i))
                cut.add(text.as_py() or "")
                if cut.chars >= size:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.mapInArrow(run, "block long, shard int, pack binary")


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_encoders: dict = {}


def _encoder(table: dict[bytes, int], key: str):
    import tiktoken

    if key not in _encoders:  # every word is one piece here
        _encoders[key] = tiktoken.Encoding(key, pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns of keep as long, n_tokens, ids array<int>), one row per row of docs: each match of pattern in the
    whole text encoded separately, no special tokens.

    Null and empty texts have no ids; repeated rows and repeated or null ids are kept, one row each; other columns
    are not read. The ranks (a vocabulary's size) are read on the driver and broadcast. The pattern's matches must
    each lie in one ' ?\\S+' run or one run of white space, as those of byte-level BPE vocabularies do."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks(ranks_path))
    key = hashlib.sha256(ranks_path.encode()).hexdigest()
    form = "<u2" if max(table.value.values(), default=0) < 1 << 16 else "<u4"

    def encode(batches):
        """Packed words to packed ids; the words of a shard, whose rows follow each other, are known until it ends or HELD is reached."""
        code, last, known, held = _encoder(table.value, key), None, {}, 0
        for batch in batches:
            packs = []
            for shard, pack in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != last or held > HELD:
                    last, known, held = shard, {}, 0
                lengths, data = _unlisted(pack.as_py())
                got, at = [], 0
                for n in lengths.tolist():
                    word, at = data[at : at + n], at + n
                    ids = known.get(word)
                    if ids is None:
                        known[word] = ids = np.array(code.encode_ordinary(word.decode()), "<u4").tobytes()
                        held += len(word) + len(ids)
                    got.append(ids)
                many, values = np.array([len(x) // 4 for x in got], np.int64), np.frombuffer(b"".join(got), "<u4")
                packs.append(_packed([planes(many, _width(many)), _squeezed(values.astype(form).tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_array(packs)], ["block", "shard", "ids"])

    def join_up(packs: pa.Table, words: pa.Table) -> pa.Table:
        names, out = [id_col, *keep, "n_tokens", "ids"], []
        of_shard = dict(zip(words["shard"].to_pylist(), words["ids"].to_pylist(), strict=True))
        for pack in packs["pack"].to_pylist():
            known, names_, per_text, flat, shard = _parts(pack)
            known, names_ = np.frombuffer(known, bool).reshape(1 + len(keep), -1), np.frombuffer(names_, np.int64).reshape(1 + len(keep), -1)
            per_text, flat, shard = unplanes(per_text).astype(np.int64), _unnumbers(flat), unplanes(shard).astype(np.int64)
            got = [_parts(of_shard[k]) for k in np.unique(shard).tolist()]  # in the order of shards, as below
            got = [(unplanes(many), np.frombuffer(_spread(values), form)) for many, values in got]
            order = np.argsort(shard, kind="stable")
            ids = np.concatenate([x for _, x in got]).astype(np.int32) if got else np.zeros(0, np.int32)
            lengths = np.concatenate([x for x, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
            begin, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            begin[order], many[order] = np.cumsum(lengths) - lengths, lengths
            values, ends = _gathered(ids, begin, many, flat)
            del flat
            edges = ends[np.r_[0, np.cumsum(per_text)]]
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
            out.append(pa.table([*(pa.array(x, mask=~k) for x, k in zip(names_, known, strict=True)), pa.array(np.diff(edges).astype(np.int64)), lists], names=names))
        return pa.concat_tables(out) if out else pa.table([*[pa.array([], pa.int64())] * (len(names) - 1), pa.array([], pa.list_(pa.int32()))], names=names)

    shards = max(SHARDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(_blocks(docs.select(*(F.col(c).cast("long") for c in (id_col, *keep)), F.col(text_col).cast("string")), pattern, block, shards))
    words = rows.where("shard is not null").repartition("shard").sortWithinPartitions("shard")
    back = words.mapInArrow(encode, "block long, shard int, ids binary")
    packs = rows.where("shard is null").select("block", "pack")
    return packs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join_up, "".join(f"`{c}` long, " for c in (id_col, *keep)) + "n_tokens long, ids array<int>")


class TokenBytes:
    """The token-byte table as one buffer with offsets."""

    def __init__(self, table: dict[bytes, int]):
        by = sorted(table.items(), key=lambda x: x[1])
        size = by[-1][1] + 1 if by else 0
        self.length, self.known = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, rank in by:
            self.length[rank], self.known[rank] = len(token), True
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(token for token, _ in by), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def decoded_rows(column: pa.Array, table: TokenBytes, most: int = 500_000):
    """Per row of a list column: (its ids, its bytes), or (None, None) for null; some rows at a time."""
    edge, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    values, at = column.values.to_numpy(zero_copy_only=False), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1)
        end = min(end, len(column))
        ids = values[edge[at] : edge[end]].astype(np.int64)
        data, ends = table.join(ids)
        cuts = np.r_[0, ends][edge[at : end + 1] - edge[at]]
        for i in range(at, end):
            yield (None, None) if null[i] else (ids[edge[i] - edge[at] : edge[i + 1] - edge[at]], data[cuts[i - at] : cuts[i - at + 1]].tobytes())
        at = end


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded` binary: the bytes of its ids. Null ids give null, none give no bytes; an id
    outside the vocabulary is an error."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks(ranks_path))

    def run(batches):
        bytes_of = TokenBytes(table.value)
        for batch in batches:
            got = [data for _, data in decoded_rows(batch.column(batch.schema.get_field_index(ids_col)), bytes_of)]
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(got)], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def bpe_digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of what bpe_encode returns, decoding its ids."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks(ranks_path))

    def run(batches):
        bytes_of = TokenBytes(table.value)
        for batch in batches:
            of_ids, of_bytes = [], []
            for ids, data in decoded_rows(batch.column(2), bytes_of):
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
