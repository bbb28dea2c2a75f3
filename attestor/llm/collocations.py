"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix is a word with the words that follow it in its piece, four at most. Suffixes are routed by their
leading words, so that all occurrences of a phrase meet in one task, which sorts pointers to them by
multikey three-way quicksort: a partition is divided by its pivot word into less, equal and greater; the
size of the equal part is the count of the words it has in common, and that part goes one word deeper, to
four words at most. A part with fewer occurrences than asked for is abandoned at once. All partitions of a
round are divided together, in numpy.

Leading words with many occurrences would bring too much into one task. Phrases of up to three words that
have more than half a route's share are found from a sample of all suffixes (one in SAMPLE); their suffixes
are routed by one word more, and the phrases themselves are counted in each block and summed. The sample
decides only which task counts a phrase; every count is over all rows. Equal suffixes of a block are one
pointer with a weight.

Blocks of words lie in the shared folder as numbers of their own vocabulary. Memory is bounded by a slice of
documents and by a route, whose number follows the corpus (ROUTE suffixes each, about).

Defined results: null texts are empty, null languages are ``und``; repeated rows count each; phrases of
equal score and count are ordered by their bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, partitions, slices, texts, written

#: Words of a phrase at most; bytes of text in a block; one of so many suffixes is looked at for routing; suffixes of a route, about.
DEPTH, SLICE, SAMPLE, ROUTE = 4, 8 << 20, 512, 1_500_000
#: Lower-cases A-Z; what ends a piece becomes a full stop, a tab a space.
PIECES = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER[c] for c in range(256))
_CODEC = "zstd"


# ---------------------------------------------------------------- blocks


def encode(raw: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of some texts, and the texts as one sequence of their numbers from 1 on; 0 ends a piece."""
    words = pa.array(b".".join(raw).translate(PIECES).replace(b".", b" . ").split(), pa.binary()).dictionary_encode()
    names = words.dictionary.to_pylist()
    seq = words.indices.to_numpy().astype(np.int64) + 1
    if b"." in names:
        stop = names.index(b".") + 1
        seq = np.where(seq == stop, 0, np.where(seq > stop, seq - 1, seq))
        names.remove(b".")
    return names, seq


def suffixes(seq: np.ndarray) -> np.ndarray:
    """A row for each of the DEPTH words of all suffixes; 0 where the piece has ended."""
    wide = np.append(seq, np.zeros(DEPTH, seq.dtype))
    at = np.flatnonzero(seq)
    out = np.zeros((DEPTH, len(at)), np.int64)
    alive = np.ones(len(at), bool)
    for d in range(DEPTH):
        out[d] = np.where(alive, wide[at + d], 0)
        alive &= out[d] > 0
    return out


def _blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """A row for each block, written to the shared folder: lang, n (words), words, seq, sample (suffixes as texts)."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, by = texts(batch.column(1)), {}
                for lang, text in zip(batch.column(0).to_pylist(), raw):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    words, seq = encode(some)
                    at = np.flatnonzero(seq)
                    if not len(at):
                        continue
                    pick = np.random.default_rng(zlib.crc32(seq.tobytes())).choice(at, -(-len(at) // SAMPLE), replace=False)
                    sample = []
                    for p in pick.tolist():
                        some = seq[p : p + DEPTH].tolist()
                        sample.append(b" ".join(words[w - 1] for w in (some[: some.index(0)] if 0 in some else some)))
                    small = seq.astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((lang, len(at), words, small.tobytes(), sample), kinds)], ["lang", "n", "words", "seq", "sample"])

    picked = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return written(picked.mapInArrow(run, "lang string, n long, words array<binary>, seq binary, sample array<binary>"))


# ---------------------------------------------------------------- routing


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task; at 0 that of the end of a piece."""
    return np.append(np.zeros(1, np.uint64), pd.util.hash_array(np.array([w.decode() for w in words], object), categorize=False) if words else np.zeros(0, np.uint64))


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more."""
    x = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def phrase_hash(phrase: str) -> int:
    """The hash of a phrase of words with a space between; as routing sees it."""
    out = np.zeros(1, np.uint64)
    for h in _hashes([w.encode() for w in phrase.split(" ")])[1:]:
        out = _longer(out, np.array([h], np.uint64))
    return int(out[0])


def grouped(cols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in sorted order and how often each is there; words are less than ``size``."""
    bits = max(1, int(size).bit_length())
    if bits * DEPTH <= 64:
        key = np.zeros(cols.shape[1], np.uint64)
        for col in cols:
            key = (key << np.uint64(bits)) | col.astype(np.uint64)
        distinct, counts = np.unique(key, return_counts=True)
        mask = np.uint64((1 << bits) - 1)
        return np.stack([((distinct >> np.uint64(bits * (DEPTH - 1 - d))) & mask).astype(np.int64) for d in range(DEPTH)]), counts
    order = np.lexsort(cols[::-1])
    cols = cols[:, order]
    first = np.flatnonzero(np.append(True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)))
    return cols[:, first], np.diff(np.append(first, cols.shape[1]))


def _dealt(blocks: DataFrame, hot, routes: int) -> DataFrame:
    """Rows (lang, route, body) of suffixes, and (lang, route, phrase, f) of hot phrases; ``hot``: a broadcast dict of arrays of hashes by language and length."""

    def run(batches):
        kinds, names = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64()], ["lang", "route", "body", "phrase", "f"]
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for lang, words, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seq = np.frombuffer(seq, np.uint16 if len(words) < 1 << 16 else np.uint32)
                cols, counts = grouped(suffixes(seq.astype(np.int64)), len(words) + 1)
                of, prefix = _hashes(words), np.zeros(cols.shape[1], np.uint64)
                depth, open_ = np.ones(cols.shape[1], np.int64), np.ones(cols.shape[1], bool)
                target = np.zeros(cols.shape[1], np.uint64)
                out = []
                for d in range(DEPTH):
                    open_ &= cols[d] > 0
                    prefix = _longer(prefix, of[cols[d]])
                    deeper = open_ & np.isin(prefix, hot.value.get((lang, d + 1), none)) if d + 1 < DEPTH else np.zeros(len(open_), bool)
                    ends = open_ & ~deeper
                    target[ends], depth[ends] = prefix[ends], d + 1
                    kept = deeper.nonzero()[0]
                    if len(kept):  # sorted, so equal phrases lie side by side
                        new = np.flatnonzero(np.append(True, (cols[: d + 1, kept[1:]] != cols[: d + 1, kept[:-1]]).any(axis=0)))
                        for at, n in zip(kept[new].tolist(), np.add.reduceat(counts[kept], new).tolist()):
                            out.append((lang, int(prefix[at] >> np.uint64(20)) % routes, None, b" ".join(words[w - 1] for w in cols[: d + 1, at].tolist()).decode(), n))
                    if d == 0:
                        routed = ends.copy()
                    else:
                        routed |= ends
                    open_ = deeper
                at = np.flatnonzero(routed)
                to = ((target[at] >> np.uint64(20)) % np.uint64(routes)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at, to = at[order], to[order]
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))[: len(to)]
                for a, b in zip(first.tolist(), np.append(first[1:], len(to)).tolist()):
                    out.append((lang, int(to[a]), pack(words, cols[:, at[a:b]], counts[at[a:b]], depth[at[a:b]]), None, None))
                for k in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256]), kinds)], names)

    return blocks.select("lang", "words", "seq").mapInArrow(run, "lang string, route int, body binary, phrase string, f long")


def pack(words: list[bytes], cols: np.ndarray, counts: np.ndarray, depth: np.ndarray) -> bytes:
    """Suffixes of a block with the words they use, as compressed bytes."""
    used, number = np.unique(cols, return_inverse=True)
    number = number.reshape(cols.shape)
    if used[0] != 0:
        used, number = np.append(0, used), number + 1
    names = b" ".join(words[w - 1] for w in used[1:].tolist())
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    head = np.array([len(used), cols.shape[1], len(names)], np.int64).tobytes()
    raw = b"".join([head, names, number.astype(kind).tobytes(), counts.astype(np.uint32).tobytes(), depth.astype(np.uint8).tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def unpack(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), _CODEC, asbytes=True)
    used, n, size = np.frombuffer(raw, np.int64, 3).tolist()
    names = raw[24 : 24 + size].split(b" ") if size else []
    kind = np.dtype(np.uint16 if used < 1 << 16 else np.uint32)
    at = 24 + size
    cols = np.frombuffer(raw, kind, DEPTH * n, at).reshape(DEPTH, n)
    at += DEPTH * n * kind.itemsize
    return names, cols, np.frombuffer(raw, np.uint32, n, at), np.frombuffer(raw, np.uint8, n, at + 4 * n)


# ---------------------------------------------------------------- multikey three-way quicksort


def frequent(cols: np.ndarray, weight: np.ndarray, least: int):
    """Yields (words, pointers, counts): of the phrases of so many words that occur ``least`` times or more, a suffix that begins with each and how often it occurs.

    ``cols`` has a row for each word of the suffixes, 0 where they end; ``weight`` tells how often each
    suffix is there. Each round divides every partition that is left at the word it has come to.
    """
    n = cols.shape[1]
    if not n or int(weight.sum()) < least:
        return
    flat = np.ascontiguousarray(cols).reshape(-1)
    kind = np.int32 if cols.size < 1 << 31 else np.int64  # of places; halves what a round holds
    at = np.arange(n, dtype=kind)  # pointers
    start, size, level = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    while len(at):
        word = flat[np.repeat((level * n).astype(kind), size) + at]
        a, b, c = word[start], word[start + size // 2], word[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the median of three
        pivot = np.repeat(pivot, size)
        part = (word > pivot).astype(np.int8) - (word < pivot).astype(np.int8)
        del word, pivot
        # each part's pointers side by side: where a pointer goes follows from how many of its part stand before it
        seg = np.repeat(np.arange(len(start), dtype=kind), size)
        counts = np.bincount(seg * 3 + (part + 1), minlength=3 * len(start))
        begin = np.cumsum(counts) - counts
        moved = np.empty(len(at), kind)
        for k in (-1, 0, 1):
            mine = np.flatnonzero(part == k)
            before = np.cumsum(counts[k + 1 :: 3]) - counts[k + 1 :: 3]  # of this part, in the partitions before
            own = seg[mine]
            moved[begin[own * 3 + k + 1] + np.arange(len(mine)) - before[own]] = at[mine]
        del seg, part
        full = np.flatnonzero(counts)
        begin, counts = begin[full], counts[full]
        total = np.add.reduceat(weight[moved], begin)
        equal, depth = full % 3 == 1, level[full // 3]
        same = flat[depth * n + moved[begin]]
        good = (total >= least) & ~(equal & (same == 0))
        found = good & equal
        for d in np.unique(depth[found]).tolist():
            those = found & (depth == d)
            yield d + 1, moved[begin[those]], total[those]
        good &= ~(equal & (depth + 1 == len(cols)))
        keep = np.repeat(good, counts)
        at, size, level = moved[keep], counts[good], (depth + equal)[good]
        start = np.cumsum(size) - size


def _counted(dealt: DataFrame, least: int) -> DataFrame:
    """Rows (lang, phrase, f) of the phrases of each route, hot ones among them, that occur ``least`` times or more."""
    names = ["lang", "phrase", "f"]

    def count(lang, bodies):
        parts = [unpack(b) for b in bodies]
        words = pa.array([w for ws, *_ in parts for w in ws], pa.binary()).dictionary_encode()
        numbers, known, k = words.indices.to_numpy().astype(np.int32) + 1, words.dictionary, 0
        cols = np.empty((DEPTH, sum(p[1].shape[1] for p in parts)), np.int32)
        at = 0
        for ws, some, _, _ in parts:
            of = np.append(np.zeros(1, np.int32), numbers[k : k + len(ws)])
            cols[:, at : at + some.shape[1]] = of[some]
            k, at = k + len(ws), at + some.shape[1]
        weight = np.concatenate([p[2] for p in parts]).astype(np.int64)
        depth = np.concatenate([p[3] for p in parts])
        del parts, words, numbers
        bodies.clear()
        for d, at, f in frequent(cols, weight, least):
            own = depth[at] <= d  # shorter phrases are hot: other routes have suffixes of them too
            at, f = at[own], f[own]
            for j in range(0, len(at), 4096):
                some = [known.take(pa.array(cols[i, at[j : j + 4096]] - 1)).to_pylist() for i in range(d)]
                phrases = [b" ".join(x).decode() for x in zip(*some)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.string()), pa.array(f[j : j + 4096], pa.int64())], names)

    def finish(lang, bodies, sums):
        if bodies:
            yield from count(lang, bodies)
        common = [(p, f) for p, f in sums.items() if f >= least]
        if common:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(common)), *map(pa.array, zip(*common))], names)

    def run(batches):
        held, bodies, sums = None, [], Counter()
        for batch in batches:
            for lang, route, body, phrase, f in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, route) != held:
                    if held is not None:
                        yield from finish(held[0], bodies, sums)
                    held, bodies, sums = (lang, route), [], Counter()
                if body is None:
                    sums[phrase] += f  # a route has few hot phrases
                else:
                    bodies.append(body)
        if held is not None:
            yield from finish(held[0], bodies, sums)

    rows = dealt.repartition(partitions(dealt.sparkSession), "lang", "route").sortWithinPartitions("lang", "route")
    return rows.mapInArrow(run, "lang string, phrase string, f long")


def phrase_counts(blocks: DataFrame, least: int) -> DataFrame:
    """Rows (lang, phrase, f) of all phrases of one to four words that occur ``least`` times or more in a language."""
    spark = blocks.sparkSession
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    routes = max(partitions(spark), -(-total // ROUTE))
    sampled = blocks.select("lang", F.explode("sample").alias("s")).select("lang", F.split(F.col("s").cast("string"), " ").alias("ws"))
    starts = sampled.select("lang", F.explode(F.sequence(F.lit(1), F.least(F.size("ws"), F.lit(DEPTH - 1)))).alias("d"), "ws").select("lang", "d", F.array_join(F.slice("ws", F.lit(1), F.col("d")), " ").alias("phrase"))
    # at most 2 * routes phrases of each length have half a route's share
    many = starts.groupBy("lang", "d", "phrase").count().where(F.col("count") * (2 * SAMPLE * routes) >= max(total, 1)).where("count > 1").collect()
    hot: dict = {}
    for r in many:
        hot.setdefault((r["lang"], r["d"]), []).append(phrase_hash(r["phrase"]))
    shared = spark.sparkContext.broadcast({k: np.array(sorted(v), np.uint64) for k, v in hot.items()})
    return written(_counted(_dealt(blocks, shared, routes), least))


# ---------------------------------------------------------------- candidates


def _part(first, length):
    return F.array_join(F.slice("ws", first, length), " ")


def mine(docs: DataFrame, most: int = 2000, least: int = 30, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two to four words.

    A phrase of ``a`` occurrences (``least`` at least) is cut where floor(2000000 a / (l + r)) is lowest, l
    and r being the counts of what stands before and after the cut. Phrases that a longer one with
    ``share`` percent of their occurrences holds are left out.
    """
    blocks = _blocks(docs, text_col, lang_col)
    counts = phrase_counts(blocks, least)
    phrases = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws")).where(F.size("ws") >= 2)
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"), "ws")
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("tail"))
    with_l = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    with_r = with_l.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    scored = with_r.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    spans = [(i, n) for n in (2, 3) for i in range(1, DEPTH - n + 2)]
    inside = reduce(lambda x, y: x.unionByName(y), (phrases.where(F.size("ws") > n).where(F.size("ws") >= i + n - 1).select("lang", _part(F.lit(i), F.lit(n)).alias("phrase"), F.col("a").alias("longer")) for i, n in spans))
    held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))
