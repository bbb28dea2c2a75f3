"""Token counts from a finite-state transducer.

The vocabulary is compiled to a deterministic transducer over bytes. A state holds, for each place
where a token could still start, the trie node reached since, the last token before the place and
how the count there differs from the count here; that settles which token ends at the next byte and
by how much the number of tokens changes, which is the transition's output. States and transitions
are made when first met and kept for the life of the worker. A start of a piece of the pre-tokenizer
leads back to the first state from anywhere.

A slice of texts is cut into chunks of equal length that run side by side. A chunk's state map is
known as far as it has been run: for every entry state if a piece starts in the chunk, since all lead
to the same state then, else for the one entry state it was run from. Such partial maps compose, and a
prefix scan composes them over all chunks. A chunk without a piece start is first run from the state
that a warm-up over the bytes before it reaches, which mostly is the right one, since BPE forgets what
is far back; after the scan, chunks that turn out to be entered in another state run again, all at
once, and the scan is repeated until every entry is known. So text without spaces runs side by side as
well. The bytes before a chunk's first piece run last, from the entries so found.

Defined results: null and empty texts have no bytes and no tokens; special tokens inside a text count
one each, as in the library; repeated rows each get their result; other columns are ignored. Memory
is bounded by the slice (8 MB of text, or one longer text) and by the tables: when they are full, only
the states in use stay.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import ByteBPE, load, special_pattern
from .common import documents, slices, utf8

#: Bytes of a chunk and of its warm-up, states after which the tables are emptied, and tokens below a trie node up to which they are told apart.
CHUNK, WARM, MOST_STATES, FEW = 1024, 64, 100_000, 32
#: Bytes of text of a slice: enough chunks to run side by side.
SLICE = 8 << 20

_LETTER, _NUMBER, _WHITE = 1, 2, 3
#: Code points of white space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other (0)."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _WHITE
    return out


def piece_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer starts a piece, for the code points of texts that start where ``text_start`` says."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    before = np.empty_like(kind)
    before[0], before[1:] = 255, kind[:-1]
    before[text_start] = 255
    white, after_white = kind == _WHITE, before == _WHITE
    after_space = np.zeros(n, bool)
    after_space[1:] = points[:-1] == 32
    start = text_start | (~white & ~after_white & (kind != before)) | (white & ~after_white) | (~white & after_white & ~after_space)
    # the last of several white characters stands apart if something follows
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:] & ~text_start[1:]
    start |= white & after_white & follows
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        ends = np.append(np.flatnonzero(text_start), n)
        limit = ends[np.searchsorted(ends, quote, side="right")]
        at = lambda k: points[np.minimum(quote + k, n - 1)]
        one = (quote + 1 < limit) & np.isin(at(1), [ord(c) for c in "stmd"])
        two = (quote + 2 < limit) & (((at(1) == ord("r")) | (at(1) == ord("v"))) & (at(2) == ord("e")) | (at(1) == ord("l")) & (at(2) == ord("l")))
        for size, which in ((2, one), (3, two & ~one)):
            start[quote[which] + 1] = False
            end = quote[which] + size
            start[end[end < limit[which]]] = True
    return start


class Transducer:
    """States, made when first met, with tables ``next`` and ``gain`` by state and byte."""

    def __init__(self, table: ByteBPE):
        self.table = table
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i in table.plain:
            node = 0
            for b in table.tokens[i]:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        # the tokens below a node that has few: children have larger numbers than their parents
        self.below: list[tuple[int, ...] | None] = [None] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            sets = [((self.token[c],) if self.token[c] >= 0 else ()) + self.below[c] if self.below[c] is not None else None for c in self.children[node].values()]
            if None not in sets and sum(map(len, sets)) <= FEW:
                self.below[node] = sum(sets, ())
        self.fitting: dict[tuple[int, int], object] = {}
        self.clear()

    def _open(self, node: int, last: int) -> object:
        """What of ``last`` matters below a node: which tokens there fit it, where they are few; none if no token does."""
        if last < 0 or self.below[node] is None:
            return last
        known = self.fitting.get((node, last), 0)
        if known == 0:
            few = tuple(t for t in self.below[node] if self.table.fits(last, t))
            known = None if not few else (-2 if len(few) == len(self.below[node]) else few)
            if len(self.fitting) >= 1 << 20:
                self.fitting.clear()
            self.fitting[node, last] = known
        return known

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.ids, self.states = {first: 0}, [first]
        self.next, self.gain = np.full((1024, 256), -1, np.int32), np.zeros((1024, 256), np.int16)

    def extend(self, state: int, byte: int) -> None:
        """Makes one transition."""
        open_starts, ended = [], None
        for node, last, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if ended is None and token >= 0 and (token in last if isinstance(last, tuple) else last < 0 or self.table.fits(last, token)):
                ended = (token, count + 1)
            if self.children[child]:
                if isinstance(last, tuple):
                    last = tuple(t for t in last if t in self.below[child]) or None
                else:
                    last = self._open(child, last)
                if last is not None:
                    open_starts.append((child, last, count))
        token, gain = ended
        key = (*((node, last, count - gain) for node, last, count in open_starts), (0, token, 0))
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
            if new >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        self.next[state, byte], self.gain[state, byte] = new, gain

    def shrink(self, *used: np.ndarray) -> None:
        """Empties full tables but for the states that the arrays hold, which are renumbered in place."""
        if len(self.states) <= MOST_STATES:
            return
        keep = [self.states[s] for s in np.unique(np.concatenate([np.zeros(1, np.int32), *used])).tolist()]
        old = np.unique(np.concatenate([np.zeros(1, np.int32), *used]))
        self.clear()
        for key in keep[1:]:
            self.ids[key] = len(self.states)
            self.states.append(key)
        while len(self.next) < len(self.states):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        for states in used:
            states[:] = np.searchsorted(old, states)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and outputs of many lanes."""
        code = (state << 8) | byte
        nxt = self.next.ravel().take(code)
        if nxt.min(initial=0) < 0:
            for c in np.unique(code[nxt < 0]).tolist():
                self.extend(c >> 8, c & 255)
            nxt = self.next.ravel().take(code)
        return nxt, self.gain.ravel().take(code)

    def gains(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The change of the token count at every byte; ``start`` says where pieces start."""
        n = len(data)
        lanes = -(-n // CHUNK)
        byte, fresh = np.zeros(lanes * CHUNK, np.int32), np.ones(lanes * CHUNK, bool)
        byte[:n], fresh[:n] = data, start
        byte, fresh = np.ascontiguousarray(byte.reshape(lanes, CHUNK).T), np.ascontiguousarray(fresh.reshape(lanes, CHUNK).T)
        out = np.zeros((CHUNK, lanes), np.int16)
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), CHUNK)
        constant = head < CHUNK
        entry, exits = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        whole = np.flatnonzero(~constant)

        def run(chosen: np.ndarray, states: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
            """Runs chunks from places ``first`` to ``last``, a piece starting at the first of them or not; returns their last states."""
            for k in range(int(first.min(initial=CHUNK)), int(last.max(initial=0))):
                self.shrink(states, entry, exits)
                going = (first <= k) & (k < last)
                if going.all():
                    states[fresh[k, chosen]] = 0
                    states[:], out[k, chosen] = self.step(states, byte[k, chosen])
                elif going.any():
                    states[going & fresh[k, chosen]] = 0
                    states[going], out[k, chosen[going]] = self.step(states[going], byte[k, chosen[going]])
            return states

        # maps of chunks with a piece start: from there on all states lead to one
        some = np.flatnonzero(constant)
        exits[some] = run(some, np.zeros(len(some), np.int32), head[some], np.full(len(some), CHUNK))
        # maps of the others, for the state that the last bytes before them lead to
        if len(whole):
            guess = np.zeros(len(whole), np.int32)
            for k in range(CHUNK - WARM, CHUNK):
                self.shrink(guess, entry, exits)
                guess[fresh[k, whole - 1]] = 0
                guess[:], _ = self.step(guess, byte[k, whole - 1])
            again = whole
            entry[again] = guess
            while len(again):
                exits[again] = run(again, entry[again], np.zeros(len(again), np.int64), np.full(len(again), CHUNK))
                known, prefix = scan(constant, entry, exits)
                # the first chunk of each stretch that is not settled: what it is really entered in is known
                again = whole[known[whole - 1] & ~known[whole]]
                entry[again] = prefix[again - 1]
        # what lies before the first piece of a chunk
        before = np.flatnonzero(constant & (head > 0))
        if len(before):
            run(before, exits[before - 1], np.zeros(len(before), np.int64), head[before])
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


def scan(constant: np.ndarray, entry: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of partial chunk maps, in log2(chunks) rounds: which are known of the first chunk's entry on, and the state they lead to.

    A map sends all states (``constant``) or one (``entry``) to ``exits``; the first chunk's map is
    constant. Of two maps in a row the later decides if it is constant; else they compose where the
    earlier leads to the later's entry, and nowhere else.
    """
    constant, entry, exits, some, step = constant.copy(), entry.copy(), exits.copy(), np.ones(len(exits), bool), 1
    while step < len(exits):
        fits = some[:-step] & some[step:] & (exits[:-step] == entry[step:])
        joined = constant[step:] | fits
        some[step:] = np.where(constant[step:], some[step:], fits)
        entry[step:] = np.where(constant[step:], entry[step:], entry[:-step])
        constant[step:] = constant[step:] | (joined & constant[:-step])
        step *= 2
    return constant & some, exits


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """The transducer of a file, kept for the life of the worker."""
    return Transducer(load(path))


def count_slice(path: str, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Token counts of texts given as joined UTF-8 bytes and offsets."""
    n = len(data)
    if not n:
        return np.zeros(len(at) - 1, np.int64)
    machine = transducer(path)
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    raw = data.tobytes()
    specials = []
    if special_pattern(machine.table) is not None:
        ends = at[1:]
        for m in special_pattern(machine.table).finditer(raw):
            a, b = m.span()
            if b <= ends[np.searchsorted(ends, a, side="right")]:
                specials.append((a, b))
                begins[[a, b]] = True
    first = (data & 0xC0) != 0x80
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    where = np.flatnonzero(first)
    start = np.zeros(n, bool)
    start[where] = piece_starts(points, begins[where])
    gains = machine.gains(data, start).astype(np.int64)
    for a, b in specials:
        gains[a:b] = 0
        gains[a] = 1
    total = np.concatenate([[0], np.cumsum(gains)])
    return total[at[1:]] - total[at[:-1]]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                data, at = utf8(batch.column(1))
                n = count_slice(path, data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return documents(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
