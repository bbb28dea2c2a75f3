"""BPE encoding with backtracking, and decoding through an offset table.

Encoding a piece: one Aho-Corasick pass finds all tokens that occur in it. From the left, the longest
token that starts at the position and fits the token before it (the pair table) is taken; where none
does, the last token is given back for its next shorter one. A position given back once is never
tried again, since the encoding of a prefix is unique, so the work is linear. The result is that of
merging by rank.

Decoding: all tokens lie in one byte string with a table of their offsets; ids become bytes by one
gather.

Defined results: null and empty texts have no ids; special tokens of the vocabulary inside a text
become their ids, as the library does by default; repeated rows each get their result; other columns
are ignored. Memory is bounded by the longest single text: rows are taken in slices, and the tables
of known pieces are emptied when full.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import ByteBPE, load, pre_tokenizer, special_pattern
from .common import documents, slices, utf8
from .units import cut, doubtful

#: Pieces and units whose ids are kept in a worker.
KEPT = 200_000


class _Kept(dict):
    """Values made on first use; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, table: ByteBPE):
        import ahocorasick

        self.table = table
        self.size = [len(t) for t in table.tokens]
        self.automaton = ahocorasick.Automaton()
        for i in table.plain:
            self.automaton.add_word(table.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.special = special_pattern(table)
        self.whole = {table.tokens[i]: i.to_bytes(4, "little") for i in table.plain}
        self.pieces = _Kept(self._piece)
        self.first = _Kept(self._unit)
        self.later = _Kept(lambda unit: self._unit(b" " + unit))

    def backtrack(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        size, fits, end = self.size, self.table.fits, len(piece)
        starts: list[list[int]] = [[] for _ in range(end)]
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            starts[last + 1 - size[token]].append(token)  # shorter ones come first
        path: list[int] = []
        choice: list[int] = []
        dead: set[int] = set()
        at, k = 0, len(starts[0]) - 1 if end else -1
        while at < end:
            options = starts[at]
            while k >= 0 and (at + size[options[k]] in dead or path and not fits(path[-1], options[k])):
                k -= 1
            if k >= 0:
                path.append(options[k])
                choice.append(k)
                at += size[options[k]]
                k = len(starts[at]) - 1 if at < end else -1
            else:
                dead.add(at)
                at -= size[path.pop()]
                k = choice.pop() - 1
        return path

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        return self.whole.get(raw) or np.array(self.backtrack(raw), "<u4").tobytes()

    def _unit(self, unit: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pre_tokenizer()(unit.decode())))

    def encode(self, raw: bytes, doubt: bool = True) -> bytes:
        """Packed ids of a whole text. ``doubt``: it may have spaces that are no place to cut."""
        if self.special is not None and self.special.search(raw):
            special = self.table.special
            return b"".join(special[part].to_bytes(4, "little") if k % 2 else self._plain(part, True) for k, part in enumerate(self.special.split(raw)))
        return self._plain(raw, doubt)

    def _plain(self, raw: bytes, doubt: bool) -> bytes:
        if not raw:
            return b""
        head, *rest = cut(raw, doubt)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest)) if head else b"".join(map(self.later.__getitem__, rest))


class Decoder:
    """Decodes packed ids through an offset table."""

    def __init__(self, table: ByteBPE):
        self.bytes = np.frombuffer(b"".join(table.tokens), np.uint8)
        self.at = np.zeros(len(table.tokens) + 1, np.int64)
        np.cumsum([len(t) for t in table.tokens], out=self.at[1:])

    def decode(self, packed: bytes) -> bytes:
        """The text in UTF-8; what isn't valid UTF-8 becomes U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        start, size = self.at[ids], self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.repeat(start - (ends - size), size) + np.arange(total)].tobytes()
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a file, kept for the life of the worker."""
    return Encoder(load(path)), Decoder(load(path))


def _encoded(batch: pa.RecordBatch, path: str):
    encoder, _ = codec(path)
    data, at = utf8(batch.column(1))
    doubt, raw, ends = doubtful(data, at), data.tobytes(), at.tolist()
    for i in range(batch.num_rows):
        yield encoder.encode(raw[ends[i] : ends[i + 1]], bool(doubt[i]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) of every document."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                packed = list(_encoded(batch, path))
                ends = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of what ``encode`` returned; null ids decode to an empty text."""
    kind = encoded.schema[id_col].dataType

    def run(batches):
        _, decoder = codec(path)
        for batch in batches:
            lists = batch.column(1)
            out = [decoder.decode(lists[i].values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if lists[i].is_valid else b"").decode() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    return documents(encoded, id_col, ids_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        _, decoder = codec(path)
        for whole in batches:
            for batch in slices(whole, text_col):
                n, ids, text = [], [], []
                for packed in _encoded(batch, path):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    text.append(hashlib.sha256(decoder.decode(packed)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
