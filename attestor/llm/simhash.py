"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared by exclusive-or and bit counts in numpy, tile against tile. A tile holds
fingerprints with neighbouring bit counts of their four 16-bit quarters. The bit counts of two
fingerprints differ, summed over the quarters, by no more than their Hamming distance, so pairs of
tiles, and inside a pair of tiles all blocks of fingerprints, whose counts are further apart than the
radius are skipped; all others are compared exactly.

Only distinct fingerprints are compared. A pair of tiles returns a spanning forest of its links, so a
group of thousands of near copies gives thousands of rows and not their square; the forests meet in a
distributed search for components. The table of bit counts (17^4 rows at most) and the tiles' bounds
(eight small numbers for each 131,072 fingerprints) reach the driver; which pairs of tiles meet is
worked out in tasks. The number of comparisons grows with the square of the number of distinct
fingerprints; that is the method's nature.

Defined results: null, empty and white texts have fingerprint zero and are linked like others; texts
with fewer words than a shingle are one shingle; repeated rows each get their row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, partitions, slices, texts, written
from .components import connected, forest

#: Fingerprints of a tile at most, tiles for small inputs, cells of a block of comparisons, and comparisons from which four parts are told apart.
TILE, LEAST_TILES, CELLS, FINE = 131_072, 16, 1 << 18, 8_000_000_000


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = raw.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        some = np.array(hashes[k : k + 8192], np.uint64)
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                fp = np.fromiter((fingerprint(t, width, seed) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, fp long")


def _counts(fp: np.ndarray, parts: int) -> np.ndarray:
    """Bit counts of the fingerprints' equal parts, highest first."""
    bits = 64 // parts
    shifts = np.arange(64 - bits, -1, -bits).astype(np.uint64)
    return np.bitwise_count((fp[:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _steps(radius: int, parts: int) -> np.ndarray:
    """Differences of the counts of all parts but the last, with what is left of the radius for the last."""
    out = [(*d, radius - sum(map(abs, d))) for d in itertools.product(range(-radius, radius + 1), repeat=parts - 1) if sum(map(abs, d)) <= radius]
    return np.array(out)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between tiles ``a`` and ``b`` (within ``a`` if b is None), as pairs of fingerprints."""
    both = a if b is None else np.concatenate([a, b])
    # finer parts skip more and make more, smaller blocks; the result is the same
    parts = 4 if len(a) * (len(both) - len(a) or len(a)) > FINE else 2
    base = 64 // parts + 1 + 2 * radius  # room for differences beyond the range of counts
    weights = base ** np.arange(parts - 1, -1, -1)

    def ordered(tile, offset):
        code = (_counts(tile, parts) + radius) @ weights
        order = np.argsort(code, kind="stable")
        return code[order], order + offset

    code_a, at_a = ordered(a, 0)
    code_b, at_b = (code_a, at_a) if b is None else ordered(b, len(a))
    first = np.flatnonzero(np.append(True, code_a[1:] != code_a[:-1])[: len(code_a)])
    last = np.append(first[1:], len(code_a))
    steps = _steps(radius, parts)
    shift, left = steps[:, :-1] @ weights[:-1], steps[:, -1]
    links_u, links_v, held = [], [], 0

    def fold():
        nonlocal links_u, links_v, held
        if held:
            u, v = np.concatenate(links_u), np.concatenate(links_v)
            nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = forest(where[: len(u)], where[len(u) :], len(nodes))
            moved = root != np.arange(len(nodes))
            links_u, links_v = [nodes[moved]], [nodes[root[moved]]]
            held = int(moved.sum())

    for i, j in zip(first.tolist(), last.tolist()):
        centre = code_a[i] + shift
        low = np.searchsorted(code_b, centre - left)
        high = np.searchsorted(code_b, centre + left, side="right")
        if b is None:
            low = np.maximum(low, i)  # each pair of blocks once
        for lo, hi in zip(low[high > low].tolist(), high[high > low].tolist()):
            width = max(1, min(hi - lo, CELLS // 64))
            rows = max(1, CELLS // width)
            for c in range(lo, hi, width):
                right = both[at_b[c : min(c + width, hi)]]
                for r in range(i, j, rows):
                    x, y = np.nonzero(np.bitwise_count(both[at_a[r : min(r + rows, j)], None] ^ right) <= radius)
                    if len(x):
                        u, v = at_a[r + x], at_b[c + y]
                        apart = u != v
                        if apart.any():
                            links_u.append(u[apart])
                            links_v.append(v[apart])
                            held += int(apart.sum())
                            if held > 1 << 20:
                                fold()
    fold()
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return both[links_u[0]], both[links_v[0]]


def _tiles(counts: pd.DataFrame) -> pd.DataFrame:
    """Deals classes of bit counts to tiles: columns q (the class), tile (its first) and parts (tiles it is spread over)."""
    n = int(counts["n"].sum())
    size = max(1, min(TILE, math.ceil(n / LEAST_TILES)))
    tile, parts, filled, at = [], [], 0, 0
    for count in counts["n"].tolist():
        if filled and filled + count > size:
            at, filled = at + 1, 0
        need = math.ceil(count / size)
        tile.append(at)
        parts.append(need)
        filled += count
        if need > 1:
            at, filled = at + need, 0
    return counts.assign(tile=tile, parts=parts)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) that connect whatever fingerprints are linked at ``radius`` or fewer differing bits.

    ``distinct`` has distinct ``fp``. The edges are spanning forests of pairs of tiles.
    """
    spark = distinct.sparkSession
    quarter = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))).cast("int") for s in (48, 32, 16, 0)]
    classed = distinct.select("fp", (((quarter[0] * 17 + quarter[1]) * 17 + quarter[2]) * 17 + quarter[3]).alias("q"))
    counts = classed.groupBy("q").agg(F.count("*").alias("n")).toPandas().sort_values("q")  # 17^4 rows at most
    if counts.empty:
        return spark.createDataFrame([], "u long, v long")
    dealt = _tiles(counts)
    # boxes of bit counts around the tiles, and the pairs of tiles whose boxes come within the radius
    q = dealt["q"].to_numpy()
    vector = np.stack([q // 17**3, q // 17**2 % 17, q // 17 % 17, q % 17], axis=1)
    n_tiles = int((dealt["tile"] + dealt["parts"]).max())
    low, high = np.full((n_tiles, 4), 99), np.full((n_tiles, 4), -1)
    for v, t, p in zip(vector, dealt["tile"], dealt["parts"]):
        low[t : t + p] = np.minimum(low[t : t + p], v)
        high[t : t + p] = np.maximum(high[t : t + p], v)
    bounds = spark.sparkContext.broadcast((low.astype(np.int8), high.astype(np.int8)))

    def meet(batches):
        """Each fingerprint with the pairs of tiles that its tile is part of."""
        low, high = bounds.value
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            fp, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in np.unique(tile).tolist():
                if t not in known:
                    gap = np.maximum(0, np.maximum(low - high[t], low[t] - high)).astype(np.int64).sum(axis=1)
                    known[t] = np.flatnonzero(gap <= radius)
                some = fp[tile == t]
                for others in np.array_split(known[t], max(1, len(some) * len(known[t]) >> 20)):
                    pair = np.minimum(others, t) * n_tiles + np.maximum(others, t)
                    columns = [np.tile(some, len(others)), np.repeat(pair, len(some)), np.repeat(others >= t, len(some))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "pair", "here"])

    of_class = spark.createDataFrame(dealt[["q", "tile", "parts"]].astype("int32"))
    tiled = classed.join(F.broadcast(of_class), "q").select("fp", (F.col("tile") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("tile"))
    sent = tiled.mapInArrow(meet, "fp long, pair long, here boolean")

    def run(pair, frame):
        fp = frame["fp"].to_numpy().view(np.uint64)
        here = frame["here"].to_numpy()
        alone = pair[0] // n_tiles == pair[0] % n_tiles
        u, v = compare(np.sort(fp[here]), None if alone else np.sort(fp[~here]), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    n = partitions(spark)
    return sent.repartition(max(n, min(n_tiles * (n_tiles + 1) // 2, 4 * n)), "pair").groupBy("pair").applyInPandas(run, "u long, v long")


def components(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, component_id) of distinct fingerprints: the smallest id reachable over links."""
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    return grouped(distinct, links(distinct.select("fp"), radius))


def grouped(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (fp, component_id) of distinct fingerprints with their least ids: the smallest id reachable over edges (u, v)."""
    roots = connected(edges).withColumnsRenamed({"node": "fp"})
    linked = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(group, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    """
    fps = written(fingerprints(docs, width, seed, id_col, text_col))
    return fps.join(components(fps, radius), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all their columns.

    Rows that repeat an id stay together if any of them is first in its component. Rows with a null id
    stay if some of their components have no other id.
    """
    fps = written(fingerprints(docs, width, seed, id_col, text_col))
    first = components(fps, radius)
    # the ids that stay: few columns, so the documents are moved once, by their id
    stays = fps.join(first, "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_kept")).distinct()
    return docs.join(stays, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
