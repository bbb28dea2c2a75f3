"""Token ids in binary shards with a minimal perfect hash index.

A shard holds the ids of documents with neighbouring keys, in ascending order of their keys:

    header     magic, bytes of an id (2 or 4), end id, rows, keys, ids, levels
    levels     size of each level of the hash
    bits       the levels' bits, as 64-bit words
    slots      by hash value: fingerprint of the key, its first row, its number of rows
    rows       key, whether it is null, place of the first id in the payload, number of ids
    payload    raw ids

The hash is a cascade of bit arrays: a level keeps the keys that meet no other key there and hands the
rest on; a key's value is the rank of its bit. A lookup reads one bit per level (a few, whatever
the number of keys), one slot, whose fingerprint turns foreign keys away, and one row.

Documents are range-partitioned by key, so shards in the order of their names hold ascending keys.
The manifest has a row for each shard, with its least and greatest key. Keyed access first finds the
shards whose range holds the key (a search in the ordered manifest), then the slot by the hash.

A shard is written once, under a name of its task attempt, and nothing is moved or replaced: the
manifest, which Spark commits, lists the shards of the attempts that counted. Shards go to the shared
folder through pyarrow's file systems.

Defined results: null and empty texts have the end id only; null keys come first; documents with equal
keys keep a row each, ordered by a hash of their text; an empty table gives no shard. Keys are
integers of up to 64 bits; other types are refused with a TypeError.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .byte_bpe import load, special_pattern
from .common import load_file, partitions, save, shared_dir, slices, utf8, written
from .units import cut, doubtful

MAGIC = b"IDSHARD1"
#: Bytes of payload after which a task begins another shard; short and other units whose ids a worker keeps; bytes of a text from which it is cut by itself; bits of a level for each key.
SHARD_BYTES, KEPT, KEPT_LONG, LONG, LOAD = 8 << 20, 2_000_000, 100_000, 4 << 20, 1.6
_HEADER = struct.Struct("<8sIIQQQQ")
_SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("rows", "<u4")])
_ROW = np.dtype([("key", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")])


# ---------------------------------------------------------------- minimal perfect hash


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer of multiplications and shifts, another one for each level."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1; other keys to anything or to -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, parts = keys.astype(np.uint64), [], []
        while len(keys):
            size = max(64, -(-int(LOAD * len(keys)) // 64) * 64)
            at = (_mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, base = np.full(len(keys), -1, np.int64), 0
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = base + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            found = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[left[found]] = (self.rank[bit >> 6] + below)[found]
            left, base = left[~found], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


# ---------------------------------------------------------------- shards


def pack(keys: list[int | None], ids: list[bytes], width: int, end_id: int) -> bytes:
    """The bytes of a shard. ``ids`` holds each document's packed ids, ordered by key."""
    rows = np.zeros(len(keys), _ROW)
    rows["key"], rows["null"] = [k or 0 for k in keys], [k is None for k in keys]
    rows["n"] = [len(x) // width for x in ids]
    rows["start"] = np.cumsum(rows["n"]) - rows["n"]
    first = np.flatnonzero(np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["null"][1:] != rows["null"][:-1]))[: len(rows)])
    counts = np.diff(np.append(first, len(rows)))
    kept = rows["null"][first] == 0
    first, counts = first[kept], counts[kept]
    names = rows["key"][first].astype(np.int64).view(np.uint64)
    index = PerfectHash.build(names)
    slots = np.zeros(len(names), _SLOT)
    at = index.lookup(names)
    slots["print"][at], slots["row"][at], slots["rows"][at] = fingerprints(names), first, counts
    head = _HEADER.pack(MAGIC, width, end_id, len(rows), len(names), int(rows["n"].sum()), len(index.sizes))
    return b"".join([head, np.array(index.sizes, "<u8").tobytes(), index.words.tobytes(), slots.tobytes(), rows.tobytes(), *ids])


class Shard:
    """Keyed access to the bytes of a shard."""

    def __init__(self, data: bytes):
        magic, self.width, self.end_id, n_rows, n_keys, self.n_ids, levels = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEADER.size
        sizes = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        self.index = PerfectHash(sizes, np.frombuffer(data, "<u8", sum(sizes) // 64, at))
        at += sum(sizes) // 8
        self.slots = np.frombuffer(data, _SLOT, n_keys, at)
        at += n_keys * _SLOT.itemsize
        self.rows = np.frombuffer(data, _ROW, n_rows, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + n_rows * _ROW.itemsize)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't here."""
        names = np.asarray(keys, np.int64).view(np.uint64)
        at = self.index.lookup(names)
        if not len(self.slots):
            return at
        here = (at >= 0) & (self.slots["print"][at] == fingerprints(names))
        here &= self.rows["key"][self.slots["row"][at]] == np.asarray(keys)
        return np.where(here, at, -1)

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """The rows of the documents with the keys, in the order of the keys; keys that aren't here have none."""
        slot = self.find(keys)
        slot = slot[slot >= 0]
        if not len(slot):
            return np.zeros(0, np.int64)
        first, n = self.slots["row"][slot].astype(np.int64), self.slots["rows"][slot].astype(np.int64)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents with that key."""
        return [self.ids[int(r["start"]) : int(r["start"]) + int(r["n"])] for r in self.rows[self.locate(np.array([key]))]]


# ---------------------------------------------------------------- encoding with the library


class Units:
    """Ids of units of at most 15 bytes, in arrays: keys (the bytes and the length) by open addressing, ids one after another."""

    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.slots, self.size = np.full(1 << 16, -1, np.int32), 0
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    @classmethod
    def keys(cls, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two words for each unit; ``data`` goes on for 16 bytes after the last."""
        view = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
        low = view[start] & cls._MASKS[np.minimum(length, 8)]
        high = view[start + 8] & cls._MASKS[np.clip(length - 8, 0, 7)]
        return low, high | length.astype(np.uint64) << np.uint64(56)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (_mix(low ^ _mix(high, 7), 8) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The unit of each key, -1 for keys that aren't here."""
        out = np.full(len(low), -1, np.int64)
        left, at = np.arange(len(low)), self._home(low, high)
        while len(left):
            found = self.slots[at]
            some = found >= 0
            left, at, found = left[some], at[some], found[some]
            same = (self.low[found] == low[left]) & (self.high[found] == high[left])
            out[left[same]] = found[same]
            left, at = left[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Distinct keys that aren't here, with their ids one after another."""
        self.low, self.high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(length) - length).astype(np.int32)])
        self.length, self.ids = np.concatenate([self.length, length.astype(np.int32)]), np.concatenate([self.ids, ids])
        new = np.arange(self.size, len(self.low))
        self.size = len(self.low)
        if 2 * self.size > len(self.slots):
            self.slots, new = np.full(1 << (4 * self.size).bit_length(), -1, np.int32), np.arange(self.size)
        at = self._home(self.low[new], self.high[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            lost = self.slots[at] != new
            new, at = new[lost], (at[lost] + 1) & (len(self.slots) - 1)


class LibraryEncoder:
    """Encodes texts with the tokenizers library, unit by unit; the ids of units are kept.

    ``short`` holds short units that follow a space, without it; ``heads`` units that begin a text,
    ``tails`` other units that follow a space.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.special, self.pattern = Tokenizer.from_file(path), load(path).special, special_pattern(load(path))
        self.dtype = f"<u{width}"
        self.lengths = np.array([len(t) for t in load(path).tokens], np.int64)
        self.heads: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.short = Units(self.dtype)

    def _joined(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of these sizes in bytes, encoded as one text in which each follows a space, and where each unit's ids end, told by the tokens' lengths."""
        [got] = self.library.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        return ids, np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes + 1), side="right")

    def _learn(self, kept: dict[bytes, bytes], units: set[bytes], space: str) -> None:
        new = units - kept.keys()
        if len(kept) + len(new) > KEPT_LONG:
            kept.clear()
            new = units
        new = list(new)
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            if not space:
                for unit, got in zip(some, self.library.encode_batch_fast([u.decode() for u in some], add_special_tokens=False)):
                    kept[unit] = np.array(got.ids, self.dtype).tobytes()
                continue
            ids, ends = self._joined((b" " + b" ".join(some)).decode(), np.fromiter(map(len, some), np.int64, len(some)))
            packed, last = ids.tobytes(), 0
            for unit, end in zip(some, (ends * ids.itemsize).tolist()):
                kept[unit] = packed[last:end]
                last = end

    def _short(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where units of at most 15 bytes are in ``short``; new ones are encoded."""
        low, high = Units.keys(data, start, length)
        found = self.short.find(low, high)
        new = np.flatnonzero(found < 0)
        if self.short.size + len(new) > KEPT and self.short.size:
            self.short.clear()
            found, new = np.full(len(low), -1, np.int64), np.arange(len(low))
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            once, ids, sizes = order[first], [], []
            for k in range(0, len(once), 10_000):
                n, at = length[once[k : k + 10_000]], start[once[k : k + 10_000]]
                begin = np.cumsum(n + 1) - n - 1
                text = data[np.arange(int((n + 1).sum())) + np.repeat(at - 1 - begin, n + 1)]  # with the byte before, which is the space
                some, ends = self._joined(text.tobytes().decode(), n)
                ids.append(some)
                sizes.append(np.diff(ends, prepend=0))
            self.short.add(low[once], high[once], np.concatenate(ids), np.concatenate(sizes))
            found[new] = self.short.find(low[new], high[new])
        return found

    def _cuts(self, text: bytes, doubt: bool) -> list[tuple[bytes, bytes, list[bytes]]]:
        """What stands before each part between special tokens (packed), the unit that begins it, and those that follow."""
        parts = [(b"", text)]
        if self.pattern is not None and self.pattern.search(text):
            found = self.pattern.split(text)
            parts = [(np.array([self.special[found[j - 1]]], self.dtype).tobytes() if j else b"", found[j]) for j in range(0, len(found), 2)]
        out = []
        for before, part in parts:
            head, *rest = cut(part, doubt or len(parts) > 1)
            out.append((before, head, rest))
        return out

    def _plain(self, data: np.ndarray, at: np.ndarray, some: np.ndarray) -> list[bytes]:
        """Packed ids of the texts ``some``, in which each space begins a unit."""
        begin, end = at[some], at[some + 1]
        size = end - begin
        whole = np.zeros(int(size.sum()) + 16, np.uint8)
        at = np.append(0, np.cumsum(size))
        whole[: at[-1]] = data[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)] if at[-1] < len(data) else data
        spaces = np.flatnonzero(whole[: at[-1]] == 32)
        # units in order: each text's head, then what follows its spaces
        per = np.searchsorted(spaces, at)
        of_head = per[:-1] + np.arange(len(some))
        head = np.zeros(len(spaces) + len(some), bool)
        head[of_head] = True
        start = np.empty(len(head), np.int64)
        start[head], start[~head] = at[:-1], spaces + 1
        stop = np.append(start[1:] - 1, at[-1])  # where the space before the next unit is
        stop[np.append(head[1:], True)] = at[1:]
        length = stop - start
        short = ~head & (length < 16)
        n, first = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        found = self._short(whole, start[short], length[short])
        n[short], first[short] = self.short.length[found], self.short.start[found]
        raw = whole.tobytes()
        rest = np.flatnonzero(~short)
        units = [raw[i:j] for i, j in zip(start[rest].tolist(), stop[rest].tolist())]
        heads = head[rest].tolist()
        self._learn(self.heads, {u for u, h in zip(units, heads) if h}, "")
        self._learn(self.tails, {u for u, h in zip(units, heads) if not h}, " ")
        got = [self.heads[u] if h else self.tails[u] for u, h in zip(units, heads)]
        more = np.frombuffer(b"".join(got), self.dtype)
        n[rest] = np.fromiter(map(len, got), np.int64, len(got)) // more.itemsize
        first[rest] = len(self.short.ids) + np.cumsum(n[rest]) - n[rest]
        pool = np.concatenate([self.short.ids, more])
        ends = np.cumsum(n)
        packed = pool[np.arange(int(n.sum())) + np.repeat(first - (ends - n), n)].tobytes()
        edges = (np.append(0, ends)[np.append(of_head, len(head))] * more.itemsize).tolist()
        return [packed[i:j] for i, j in zip(edges[:-1], edges[1:])]

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Packed ids of texts given as joined UTF-8 bytes and offsets."""
        doubt, raw, ends = doubtful(data, at), data.tobytes(), at.tolist()
        slow = doubt | (np.diff(at) > LONG)
        if self.pattern is not None and self.pattern.search(raw):
            slow |= np.array([self.pattern.search(raw, i, j) is not None for i, j in zip(ends[:-1], ends[1:])], bool)
        out: list[bytes] = [b""] * len(slow)
        plain = np.flatnonzero(~slow)
        if len(plain):
            for k, packed in zip(plain.tolist(), self._plain(data, at, plain)):
                out[k] = packed
        for k in np.flatnonzero(slow).tolist():
            cuts = self._cuts(raw[ends[k] : ends[k + 1]], bool(doubt[k]))
            self._learn(self.heads, {head for _, head, _ in cuts}, "")
            self._learn(self.tails, {unit for _, _, rest in cuts for unit in rest}, " ")
            out[k] = b"".join([x for before, head, rest in cuts for x in (before, self.heads[head], *map(self.tails.__getitem__, rest))])
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str, width: int) -> LibraryEncoder:
    return LibraryEncoder(path, width)


# ---------------------------------------------------------------- writing and reading


def read_shard(where: str, name: str) -> Shard:
    return Shard(load_file(where, name))


def write(docs: DataFrame, path: str, where: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of ``docs`` below ``where``; the manifest: name, part, n (their order), rows, ids, least, greatest (keys) and base (ids of all shards before)."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: keys are integers, not {docs.schema[id_col].dataType.simpleString()}")
    size = len(load(path).tokens)
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(partitions(spark), F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "text")

    schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("n", pa.int32()), *((c, pa.int64()) for c in ("rows", "ids", "least", "greatest"))])

    def run(batches):
        keys, ids, bytes_, part, n = [], [], 0, 0, 0
        encoder = library_encoder(path, width)

        def flush():
            nonlocal keys, ids, bytes_, n
            name = f"shard-{part:06d}-{n:06d}-{uuid.uuid4().hex}"
            save(where, name, pack(keys, ids, width, end_id))
            real = [k for k in keys if k is not None]
            values = [name, part, n, len(keys), bytes_ // width, min(real, default=None), max(real, default=None)]
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema.names)
            keys, ids, bytes_, n = [], [], 0, n + 1
            return row

        for whole in batches:
            for batch in slices(whole, "text"):
                part = batch.column(0)[0].as_py()
                for key, packed in zip(batch.column(1).to_pylist(), encoder.encode(*utf8(batch.column(2)))):
                    keys.append(key)
                    ids.append(packed + end)
                    bytes_ += len(ids[-1])
                    if bytes_ >= SHARD_BYTES:
                        yield flush()
        if keys:
            yield flush()

    manifest = written(ordered.mapInArrow(run, "name string, part int, n int, rows long, ids long, least long, greatest long"), f"{where}-manifest")
    before = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame, where: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of all documents: each key's rows as the index finds them.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = read_shard(where, name)
                null = shard.rows["null"] == 1  # rows without a key come first and no index has them
                found = shard.locate(np.unique(shard.rows["key"][~null]))
                if len(found) != int((~null).sum()):
                    raise ValueError(f"{name}: the index misses keys")
                rows = shard.rows[np.concatenate([np.flatnonzero(null), found])]
                ids = shard.ids.astype("<u4")
                start, n = rows["start"].astype(np.int64), rows["n"].astype(np.int64)
                crc = [zlib.crc32(ids[a : a + b].tobytes()) for a, b in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], mask=rows["null"] == 1), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    dealt = manifest.select("name", "base").repartition(partitions(spark), "name")
    return dealt.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, where: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Rows (key, ids array<int>) of the documents with the ``keys``, once for each distinct key and document.

    A key meets the partitions of the writing job whose range holds it (one row for each of them is
    broadcast), then by equality their shards, of which those whose range holds it are opened; there a
    key costs one lookup.
    """
    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    inside = F.col("key").between(F.col("least"), F.col("greatest"))
    parts = manifest.groupBy("part").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    dealt = asked.join(F.broadcast(parts), inside).select("key", "part").join(manifest.select("part", "name", "least", "greatest"), "part").where(inside).groupBy("name").agg(F.collect_list("key").alias("keys"))

    def run(batches):
        for batch in batches:
            for name, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = read_shard(where, name)
                rows = shard.rows[shard.locate(np.array(some, np.int64))]
                ids = [shard.ids[a : a + n].astype(np.int32) for a, n in zip(rows["start"].astype(np.int64).tolist(), rows["n"].astype(np.int64).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"]), pa.array(ids, pa.list_(pa.int32()))], [key_col, "ids"])

    return dealt.mapInArrow(run, f"{key_col} long, ids array<int>")


def write_and_read(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", where: str | None = None) -> DataFrame:
    """Writes the shards, by default to a new shared folder, and returns what is read back."""
    where = where or shared_dir(docs.sparkSession)
    return read(write(docs, path, where, end_id, id_col, text_col), where, id_col)
