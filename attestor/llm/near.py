"""Near-duplicates by SimHash, decided by exact similarity of word shingles.

Documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are linked.
SimHash fingerprints of 256 bits propose the pairs and the sets themselves decide: no link rests on a
sketch. A bit of two sets that are 0.8 alike differs with probability 0.15 (0.19 at most, for sets of
four and five); ``radii`` lies more than four standard deviations above, so a pair at 0.8 is missed
with a probability of some 1e-5 (binomial, estimated), closer pairs less.

Fingerprints in the order of the sets' sizes make tiles. Tiles are compared with exclusive-or and bit
counts, if some of their sizes allow the similarity. What is left to do in two rounds grows with the
links and not with the square of a group:

1. each pair of tiles proposes a spanning forest of its close pairs, the closest first, and the sets
   decide about those;
2. fingerprints with a close pair are compared once more, and all close pairs that are still in
   different groups are decided.

The number of comparisons grows with the square of the number of distinct sets, as in ``simhash``.

Defined results: texts with fewer words than a shingle are one shingle; null, empty and white texts
are alike; other columns are ignored. Exactly one row of each group stays: that with the smallest id
(null ids last), of those the one with the smallest hash of its text, of rows that repeat both any one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, partitions, slices, texts, written
from .components import connected, forest
from .simhash import grouped

#: Fingerprints of a tile at most, tiles for small inputs, rows and columns of a block of comparisons, proposals that are held.
TILE, LEAST_TILES, ROWS, COLUMNS, HELD = 65_536, 32, 64, 4096, 1 << 20
#: 64-bit words of a fingerprint.
WORDS = 4
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """The ordered distinct hashes of a text's word shingles."""
    import xxhash

    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64))


def simhash(some: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(some), 255):  # so many fit in the sums of bytes
        x = some[k : k + 255, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(some)).view(np.uint64)


def radii(similarity: float) -> np.ndarray:
    """Differing bits of two sets so similar at most: of half a fingerprint and of a whole one, for small sets and for others."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi * np.array([[1.25], [1.07]])
    n = np.array([32 * WORDS, 64 * WORDS])
    return np.ceil(n * p + 4.4 * np.sqrt(n * p * (1 - p))).astype(np.int64)


def _digest(some: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(some.tobytes()) if len(some) else 0


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ordered sets have the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def spanning(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which edges make a spanning forest of nodes 0..n-1, the shortest first."""
    if not len(u):
        return np.zeros(0, np.int64)
    n = int(max(u.max(), v.max())) + 1
    order = np.argsort(far, kind="stable")
    left, root, out = order, np.arange(n), []
    while True:
        a, b = root[u[left]], root[v[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        best = np.full(n, len(left))
        np.minimum.at(best, a, np.arange(len(left)))
        np.minimum.at(best, b, np.arange(len(left)))
        some = np.unique(best[best < len(left)])
        out.append(left[some])
        root = forest(a[some], b[some], n)[root]


def propose(a: tuple, b: tuple | None, similarity: float, every: bool):
    """Close pairs of the tiles ``a`` and ``b`` (within ``a`` if b is None) with different labels, as arrays (u, v) of keys, u < v: all of them or a spanning forest.

    A tile is (keys, sizes, fingerprints, labels), ordered by sizes.
    """
    alone = b is None
    b = a if alone else b
    offset = 0 if alone else len(a[0])
    keys = a[0] if alone else np.concatenate([a[0], b[0]])
    small, other = radii(similarity)
    held: list[list[np.ndarray]] = []

    def fold():
        nonlocal held
        if held:
            u, v, far = (np.concatenate(x) for x in zip(*held))
            some = spanning(u, v, far)
            held = [[u[some], v[some], far[some]]]

    def told(u, v):
        return np.minimum(keys[u], keys[v]), np.maximum(keys[u], keys[v])

    columns = [np.ascontiguousarray(b[2][:, k]) for k in range(WORDS)]
    for i in range(0, len(a[0]), ROWS):
        j = min(i + ROWS, len(a[0]))
        low = int(np.searchsorted(b[1], similarity * a[1][i] - 1e-9))
        high = int(np.searchsorted(b[1], a[1][j - 1] / similarity + 1e-9, side="right"))
        for c in range(max(low, i) if alone else low, high, COLUMNS):
            d = min(c + COLUMNS, high)
            far = sum(np.bitwise_count(a[2][i:j, k, None] ^ columns[k][c:d]) for k in range(WORDS // 2))
            near = np.flatnonzero(far <= (small if a[1][i] <= 6 else other)[0])
            if not len(near):
                continue
            x, y = i + near // (d - c), c + near % (d - c)
            least, most = np.minimum(a[1][x], b[1][y]), np.maximum(a[1][x], b[1][y])
            far = far.ravel()[near].astype(np.int64)
            limit = np.where(least <= 5, small[:, None], other[:, None])
            close = (far <= limit[0]) & (least >= similarity * most - 1e-9) & (a[3][x] != b[3][y])
            if alone:
                close &= y > x
            x, y, far = x[close], y[close], far[close]
            for k in range(WORDS // 2, WORDS):
                far += np.bitwise_count(a[2][x, k] ^ b[2][y, k])
            close = far <= limit[1][close]
            if close.any():
                held.append([x[close], y[close] + offset, far[close]])
                if sum(len(h[0]) for h in held) > HELD:
                    if every:
                        for u, v, _ in held:
                            yield told(u, v)
                        held = []
                    else:
                        fold()
    if not every:
        fold()
    for u, v, _ in held:
        yield told(u, v)


def _sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, h, fp, size, sketch): h is a hash of the text, fp a digest of the set, sketch its fingerprint."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                sets = [shingles(t, width) for t in texts(batch.column(1))]
                fp = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash(s).tobytes() for s in sets], pa.binary())], ["id", "h", "fp", "size", "sketch"])

    return documents(docs, id_col, text_col).withColumn("_h", F.xxhash64(text_col)).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, h long, fp long, size int, sketch binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (fp, shingles) of documents (id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t, width) for t in texts(batch.column(1))]
                fp = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    return docs.mapInArrow(run, "fp long, shingles binary")


def proposals(points: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Rows (u, v), u < v, of close pairs of distinct ``points`` (fp, size, sketch, label) with different labels: all, or a spanning forest of each pair of tiles."""
    spark = points.sparkSession
    n = partitions(spark)
    most = max(1, min(TILE, -(-points.count() // LEAST_TILES)))

    def pack(batches):
        held, size = [], 0

        def tile():
            whole = pa.concat_batches(held)
            sizes = whole.column(2).to_numpy()
            raw = [np.ascontiguousarray(whole.column(k).to_numpy()).tobytes() for k in (1, 2, 4)]
            name = int(whole.column(0)[0].as_py()) << 32 | made
            sketches = b"".join(whole.column(3).to_pylist())
            return pa.RecordBatch.from_pydict({"tile": pa.array([name]), "low": pa.array([int(sizes[0])]), "high": pa.array([int(sizes[-1])]), "fp": [raw[0]], "size": [raw[1]], "sketch": [sketches], "label": [raw[2]]})

        made = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, most - size)
                held.append(some)
                size += some.num_rows
                batch = batch.slice(some.num_rows)
                if size == most:
                    yield tile()
                    held, size, made = [], 0, made + 1
        if size:
            yield tile()

    # tiles in the order of sizes: partitions by range, each in order
    ordered = points.repartitionByRange(n, "size", "fp").sortWithinPartitions("size", "fp").select(F.spark_partition_id().cast("long").alias("part"), "fp", "size", "sketch", "label")
    tiles = written(ordered.mapInArrow(pack, "tile long, low long, high long, fp binary, size binary, sketch binary, label binary"))
    bounds = tiles.select("tile", "low", "high")
    here, there = (bounds.select(*(F.col(c).alias(f"{c}_{k}") for c in bounds.columns)) for k in "ab")
    pairs = here.join(there, (F.col("tile_a") <= F.col("tile_b")) & (F.col("high_a") >= similarity * F.col("low_b") - 1e-9)).select("tile_a", "tile_b")
    side = lambda k: tiles.select(*(F.col(c).alias(f"{c}_{k}") for c in ("tile", "fp", "size", "sketch", "label")))
    met = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b").repartition(4 * n, "tile_a", "tile_b")
    kinds = (np.int64, np.int32, np.uint64, np.int64)

    def run(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for r in range(batch.num_rows):
                name_a, name_b = columns[0][r].as_py(), columns[1][r].as_py()
                a, b = ([np.frombuffer(columns[k + j][r].as_buffer(), t) for j, t in enumerate(kinds)] for k in (2, 6))
                a[2], b[2] = a[2].reshape(-1, WORDS), b[2].reshape(-1, WORDS)
                for u, v in propose(tuple(a), None if name_a == name_b else tuple(b), similarity, every):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    names = [f"{c}_{k}" for k in "ab" for c in ("fp", "size", "sketch", "label")]
    return met.select("tile_a", "tile_b", *names).mapInArrow(run, "u long, v long").distinct()


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets (fp, shingles) have the similarity."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [alike(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64), similarity) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    side = lambda k: sets.select(F.col("fp").alias(k), F.col("shingles").alias(f"{k}_set"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates of ``docs``, that with the smallest id, with all its columns."""
    fps = written(_sketches(docs, width, id_col, text_col))
    distinct = written(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    points = distinct.select("fp", "size", "sketch")
    closest = written(proposals(points.withColumn("label", F.col("fp")), similarity, every=False))
    # a forest has every fingerprint that is close to another
    wanted = closest.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    ids = fps.join(wanted, "fp", "left_semi").select(F.col("id").alias("_id")).distinct()
    some = documents(docs, id_col, text_col).toDF("id", "text").join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = written(_sets(some, width).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    edges = written(linked(closest, sets, similarity))
    labels = connected(edges).select(F.col("node").alias("fp"), "root")
    apart = written(points.join(wanted, "fp", "left_semi").join(labels, "fp", "left").select("fp", "size", "sketch", F.coalesce("root", "fp").alias("label")))
    others = proposals(apart, similarity, every=True).join(closest, ["u", "v"], "left_anti")
    edges = edges.unionByName(linked(others, sets, similarity))
    first = grouped(distinct, edges)
    stays = written(first.select("component_id").distinct().select(F.col("component_id.id").alias("_id"), F.col("component_id.h").alias("_hash")))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    kept = docs.join(stays, same, "left_semi")
    # rows that repeat id and text, if there are any, are told apart by nothing; one stays
    if fps.join(stays, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")), "left_semi").groupBy("id", "h").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_hash"]).drop("_hash")
