"""Benchmark decontamination with suffix arrays of the training text.

The documents are indexed in shards: all words of a slice of documents, as numbers of the benchmark's
vocabulary, in one sequence, and the sorted array of its suffixes. Suffixes that start with a word
which no benchmark item has are left out; they match nothing. Every suffix of every item is looked up
in every shard, all at once, by binary search that narrows each one's range word by word; the depth at
which a range runs empty is its longest verbatim match, the last range holds its places. A window
(13 consecutive item words, or a whole shorter item) occurs where the range at its length isn't empty.

The sort goes as deep as the longest item: first by as many words as fit 62 bits, then by doubling
among what is still tied.

The items lie in the shared folder in blocks of at most 16 MB of text. A worker reads them one after
another for each shard and holds one at a time, the last one from shard to shard; documents are never
moved. Memory is bounded by a shard (8 MB of text, or one longer text) and a block.

Suffixes with the same range of places are one: ranges of one length are disjoint, so what they hold is
at most the shard for each length, however often items repeat each other or the documents' boilerplate.

Defined results: null texts and texts without words have no words, no hits and aren't contaminated;
items without words have no window; null item ids count as hits but are not listed; repeated rows
each get their row; other columns are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, load_file, save, shared_dir, slices, texts

#: Bytes of item text in a block, and of document text in a shard.
BLOCK, SHARD = 16 << 20, 8 << 20
#: Lower-cases A-Z and turns all that isn't part of a word to spaces.
WORDS = bytes(LOWER[c] if 48 <= c <= 57 or 97 <= LOWER[c] <= 122 or c >= 128 else 32 for c in range(256))


class TestSet:
    """All suffixes of a block of items: where each starts, how long it is and whose it is."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.names = [name for name, _ in items]
        words = [text.translate(WORDS).split() for _, text in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        sizes = np.array([len(w) for w in words], np.int64)
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.tokens = np.array([self.vocabulary[w] for ws in words for w in ws] + [0], np.int32)
        self.item = np.repeat(np.arange(len(words)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.start = np.arange(len(self.item))
        self.left = ends - self.start
        # a window starts here: enough words are left, or the whole of a short item
        self.window = np.where(self.left >= window, window, 0)
        whole = self.left == sizes[self.item] if len(sizes) else np.zeros(0, bool)
        self.window[whole & (self.left < window)] = self.left[whole & (self.left < window)]


def suffix_array(tokens: np.ndarray, depth: int, vocabulary: int) -> np.ndarray:
    """Places of ``tokens`` that aren't 0, sorted by the ``depth`` words from there on, up to the first 0.

    ``tokens`` ends with enough zeros to read ``depth`` words from every place.
    """
    at = np.flatnonzero(tokens)
    bits = max(1, int(vocabulary).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(len(at), np.int64)
    alive = np.ones(len(at), bool)
    for k in range(width):
        word = np.where(alive, tokens[np.minimum(at + k, len(tokens) - 1)], 0)
        alive &= word > 0
        key = (key << bits) | word
    order = np.argsort(key, kind="stable")
    at, key, alive = at[order], key[order], alive[order]
    new = np.append(True, key[1:] != key[:-1])[: len(at)]
    group = np.flatnonzero(new)
    # ranks of places: one more than the slot of their group's first, 0 for what matches nothing
    rank = np.zeros(len(tokens), np.int64)
    rank[at] = np.repeat(group, np.diff(np.append(group, len(at)))) + 1
    tied = np.repeat(np.diff(np.append(group, len(at))) > 1, np.diff(np.append(group, len(at)))) & alive
    slots = np.flatnonzero(tied)
    while width < depth and len(slots):
        places = at[slots]
        nxt = rank[np.minimum(places + width, len(tokens) - 1)]
        order = np.lexsort((nxt, rank[places]))
        places, nxt = places[order], nxt[order]
        at[slots] = places
        old = rank[places]
        new = np.append(True, (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1]))[: len(slots)]
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, len(slots)))
        rank[places] = np.repeat(slots[group], size) + 1
        slots = slots[np.repeat(size > 1, size) & (nxt > 0)]
        width *= 2
    return at


def search(tokens: np.ndarray, suffixes: np.ndarray, test: TestSet):
    """Looks up all suffixes of the test set.

    Returns the longest match of each (words), the range of places that have it, and the range of
    places that have its window (empty if none has).
    """
    n = len(test.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(suffixes), np.int64)
    length = np.zeros(n, np.int64)
    at_window = np.zeros((n, 2), np.int64)
    going = np.arange(n) if len(suffixes) else np.zeros(0, np.int64)

    def bound(lo, hi, word, depth, past):
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            there = tokens[suffixes[np.minimum(mid, len(suffixes) - 1)] + depth]
            right = open_ & ((there <= word) if past else (there < word))
            hi = np.where(open_ & ~right, mid, hi)
            lo = np.where(right, mid + 1, lo)

    depth = 0
    while len(going):
        word = test.tokens[test.start[going] + depth]
        lo = bound(low[going], high[going], word, depth, False)
        hi = bound(lo, high[going], word, depth, True)
        found = lo < hi
        going, depth = going[found], depth + 1
        low[going], high[going], length[going] = lo[found], hi[found], depth
        full = going[test.window[going] == depth]
        at_window[full, 0], at_window[full, 1] = low[full], high[full]
        going = going[test.left[going] > depth]
    return length, low, high, at_window


def _shard(raw: list[bytes], blocks):
    """Per text: words, hit words, longest match (words, first word, item) and ids of items."""
    joined = b" ".join([*raw, b""]).translate(WORDS)
    letters = np.frombuffer(joined, np.uint8) != 32
    starts = np.flatnonzero(letters & ~np.append(False, letters[:-1])[: len(letters)])
    ends = np.cumsum([len(t) + 1 for t in raw])
    doc = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(doc, minlength=len(raw))
    place = np.arange(len(doc)) + doc  # one 0 behind each text
    first = np.cumsum(n_words) - n_words + np.arange(len(raw))
    words = joined.split()
    total = len(words) + len(raw)
    hit = np.zeros(total + 1, bool)
    best = [(0, 0, None)] * len(raw)
    items: list[set] = [set() for _ in raw]
    doc_of = np.zeros(total, np.int64)
    doc_of[place] = doc
    for test in blocks:
        tokens = np.zeros(total + test.longest + 1, np.int32)
        tokens[place] = np.fromiter(map(test.vocabulary.get, words, repeat(0)), np.int32, len(words))
        suffixes = suffix_array(tokens, test.longest, len(test.vocabulary))
        length, low, high, window = search(tokens, suffixes, test)
        matched = np.flatnonzero(window[:, 1] > window[:, 0])
        if not len(matched):
            continue
        # windows with the same places are one; of one size they are disjoint
        ranges, where = np.unique(np.column_stack([window[matched], test.window[matched]]), axis=0, return_inverse=True)
        order = np.argsort(where.ravel(), kind="stable")
        members = np.split(test.item[matched[order]], np.cumsum(np.bincount(where.ravel(), minlength=len(ranges)))[:-1])
        for (a, b, _), who in zip(ranges.tolist(), members):
            names = {test.names[i] for i in np.unique(who).tolist()}
            for d in np.unique(doc_of[suffixes[a:b]]).tolist():
                items[d] |= names
        for size in np.unique(ranges[:, 2]).tolist():
            mark = np.zeros(len(suffixes) + 1, np.int32)
            some = ranges[ranges[:, 2] == size]
            np.add.at(mark, some[:, 0], 1)
            np.add.at(mark, some[:, 1], -1)
            at = suffixes[np.cumsum(mark[:-1]) > 0]
            cover = np.zeros(total + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            hit |= np.cumsum(cover) > 0
        # the longest match of each place: ranges by length, so that longer ones overwrite
        depth = length[matched]
        spans, which = np.unique(np.column_stack([depth, low[matched], high[matched]]), axis=0, return_index=True)
        longest, whose = np.zeros(len(suffixes), np.int32), np.zeros(len(suffixes), np.int32)
        for (size, a, b), k in zip(spans.tolist(), which.tolist()):
            longest[a:b], whose[a:b] = size, test.item[matched[k]]
        slot = np.flatnonzero(longest)
        at = suffixes[slot]
        order = np.lexsort((at, -longest[slot], doc_of[at]))
        for k in order[np.append(True, np.diff(doc_of[at][order]) > 0)].tolist():
            d, size = int(doc_of[at[k]]), int(longest[slot[k]])
            if size > best[d][0]:
                best[d] = (size, int(at[k] - first[d]), test.names[int(whose[slot[k]])])
    n_hit = np.bincount(doc_of[np.flatnonzero(hit[:total])], minlength=len(raw))
    return n_words, n_hit, best, items


class Blocks:
    """The blocks of a test set in the shared folder, read one after another."""

    held: tuple[str, TestSet] | None = None  # a worker's last block

    def __init__(self, where: str):
        self.where, self.names = where, []

    def add(self, block: TestSet) -> None:
        self.names.append(f"block-{len(self.names):06d}")
        save(self.where, self.names[-1], pickle.dumps(block))

    def __iter__(self):
        for name in self.names:
            place = f"{self.where}/{name}"
            if Blocks.held is None or Blocks.held[0] != place:
                Blocks.held = None  # goes before the next one comes
                Blocks.held = (place, pickle.loads(load_file(self.where, name)))
            yield Blocks.held[1]


def test_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Blocks:
    """Writes the items in blocks; the driver holds one at a time."""
    blocks, items, size = Blocks(shared_dir(benchmark.sparkSession)), [], 0
    for name, text in benchmark.select(id_col, text_col).toLocalIterator():
        raw = (text or "").encode()
        if items and size + len(raw) > BLOCK:
            blocks.add(TestSet(items, window))
            items, size = [], 0
        items.append((name, raw))
        size += len(raw)
    if items:
        blocks.add(TestSet(items, window))
    return blocks


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, n_words, n_hit, items, longest, longest_at, longest_item), one for each row of ``docs``.

    ``n_hit`` counts the document's words inside any occurrence of a window; ``items`` lists the items
    with an occurring window, sorted as strings. ``longest`` is the longest verbatim match of those,
    ``longest_at`` its first word and ``longest_item`` whose it is.
    """
    blocks = test_blocks(benchmark, window, item_col, item_text)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SHARD):
                n_words, n_hit, best, items = _shard(texts(batch.column(1)), blocks)
                columns = [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(str(x) for x in names if x is not None) for names in items], pa.list_(pa.string())),
                    pa.array([b[0] for b in best], pa.int64()),
                    pa.array([b[1] if b[0] else None for b in best], pa.int64()),
                    pa.array([None if b[2] is None else str(b[2]) for b in best], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_hit", "items", "longest", "longest_at", "longest_item"])

    schema = f"{id_col} {kind.simpleString()}, n_words long, n_hit long, items array<string>, longest long, longest_at long, longest_item string"
    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def contaminated(share: int = 20):
    """The rule: some word is hit, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``matches`` found, with the item ids as a count and a digest."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    The verdicts are made beside the rows they are about, so nothing is shuffled. Rows with a null id
    are judged like others.
    """
    blocks = test_blocks(benchmark, window, "item_id", "text")
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SHARD):
                n_words, n_hit, _, _ = _shard(texts(batch.column(place)), blocks)
                yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(run, schema)
