"""Approximate nearest neighbours over shifted Hilbert curves.

Each curve projects the vectors to a few random directions, maps the coordinates to the unit cube by
their quantiles, shifts them by its own random amounts and numbers the cells along a Hilbert curve.
The curve is cut into blocks of about equal numbers of vectors; a query meets the vectors of its own
block and of the blocks before and after. What the curves find is merged and ranked by exact inner
products in double precision.

Near-isotropic vectors have their neighbours spread over any ordering, so a window of constant size
would lose them as the table grows. Larger tables have nearer neighbours, though, and the share of the
table that a window takes may fall slowly: a curve has ``BLOCKS`` x (n / ``FEW``) ^ ``FALL`` blocks. All
curves together compare a query with 0.96 of a table of ``FEW`` vectors, 0.59 of 51,000 and 0.3 of five
millions, pairs that several curves bring together counted each time. Fewer than ``FEW`` vectors are one
window. A block is cut further into chunks of bounded size, so tasks stay bounded.

Equal vectors are folded to one with their smallest ids, as many as a result can hold and one more
(the query itself), so a vector that a third of the rows share is one candidate and one query.

The curves are fitted (quantiles, block bounds) on a bounded sample of about ``SAMPLE`` vectors;
every vector is indexed. Measured recall against brute force is in the README: over 0.9.

Defined results: vectors that are null, zero or hold null or non-finite components take no part,
as do rows with a null id and vectors of another length than the most common one (the smaller, if
two are as common); rows that repeat an id and its vector count once; fewer than k candidates give
fewer rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Curves, blocks of a curve of FEW vectors, vectors from which on there are several windows, power by which blocks grow, projected directions, bits of each, vectors the curves are fitted on (about), candidates and queries of a chunk.
CURVES, BLOCKS, FEW, FALL, DIRECTIONS, BITS, SAMPLE, CHUNK, QUERIES = 24, 75, 2000, 0.15, 6, 6, 20_000, 50_000, 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows), each coordinate below 2**bits.

    Coordinates are untangled from the highest bit down (a clear bit swaps low bits with the first
    coordinate, a set one flips the first's), Gray-coded and interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            is_set = (x[i] & q) > 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(is_set, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


class Curves:
    """Projections, quantiles, shifts and block bounds of all curves."""

    def __init__(self, sample: np.ndarray, ties: np.ndarray, blocks: int, curves: int, seed: int = 7):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.directions, self.quantiles, self.shifts, self.bounds = [], [], [], []
        width = min(DIRECTIONS, dim)
        rotation = None
        for c in range(curves):
            k = c % max(1, dim // width)
            if k == 0:
                rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
            self.directions.append(rotation[:, k * width : (k + 1) * width])
            self.shifts.append(rng.random(width) * 0.25)
            self.quantiles.append(np.quantile(sample @ self.directions[c], np.linspace(0, 1, 257), axis=0))
            keys = np.sort(self.keys(sample, ties, c))
            self.bounds.append(keys[(np.arange(1, blocks) * len(keys)) // blocks])

    def keys(self, v: np.ndarray, ties: np.ndarray, c: int) -> np.ndarray:
        """Places along curve ``c``; ``ties`` (16 bits) order what shares a cell."""
        p = v @ self.directions[c]
        unit = np.stack([np.interp(p[:, d], self.quantiles[c][:, d], np.linspace(0, 1, 257)) for d in range(p.shape[1])], axis=1)
        cells = np.minimum((unit + self.shifts[c]) / 1.25 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        return (hilbert(cells, BITS) << 16) | ties

    def blocks(self, v: np.ndarray, ties: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.bounds[c], self.keys(v, ties, c), side="right")


def _matrix(column) -> np.ndarray:
    """Vectors of a list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def _best(cand: pd.DataFrame, query: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a chunk's candidates for each query, with exact scores; ties at the cut go to the smaller ids."""
    cand = cand.iloc[np.argsort(np.array([ids[0] for ids in cand["ids"]]), kind="stable")]  # places in the order of their least ids
    a, b = np.vstack(query["v"].to_numpy()).astype(np.float64), np.vstack(cand["v"].to_numpy()).astype(np.float64)
    out = []
    for start in range(0, len(a), 512):
        rows = a[start : start + 512]
        score = rows @ b.T
        take = min(k, len(b))
        # all that comes within rounding of the k-th best, then exactly the k best of those
        least = -np.partition(-score, take - 1, axis=1)[:, take - 1]
        which, flat = np.nonzero(score >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
        exact = (a[start + which] * b[flat]).sum(axis=1)
        order = np.lexsort((flat, -exact, which))
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order = order[place < take]
        which, flat, exact = which[order] + start, flat[order], exact[order]
        out.append(pd.DataFrame({"query": query["g"].to_numpy()[which], "cand": cand["g"].to_numpy()[flat], "score": exact, "ids": cand["ids"].to_numpy()[flat]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that ``is_query`` selects, the k nearest found, ties to the smaller id."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dim = lengths[0]["n"]
    key = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")))
    rows = rows.where(F.size("v") == dim).withColumn("g", key)
    # the smallest ids of equal vectors; the window keeps no more than that of a task's rows before the exchange
    first = Window.partitionBy("g").orderBy("id")
    ranked = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    folded = written(ranked.groupBy("g").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")))
    asked = rows.where("q").select("id", "g").distinct()
    n, n_asked = folded.count(), asked.count()
    if not n_asked:
        return empty
    share = F.pmod(F.xxhash64("g"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    tie = F.pmod(F.xxhash64(F.lit(2), "g"), F.lit(1 << 16)).alias("tie")
    sample = folded.where(share).select("v", tie).toArrow().to_pandas()  # about SAMPLE rows
    if sample.empty:
        sample = folded.limit(SAMPLE).select("v", tie).toPandas()
    blocks, n_curves = (int(BLOCKS * (n / FEW) ** FALL), CURVES) if n >= FEW else (1, 1)
    window = min(3, blocks)  # three blocks, also at the curve's ends
    curves = spark.sparkContext.broadcast(Curves(np.vstack(sample["v"].to_numpy()), sample["tie"].to_numpy().astype(np.int64), blocks, n_curves))
    parts, asks = max(1, math.ceil(n / blocks / CHUNK)), max(1, math.ceil(window * n_asked / blocks / QUERIES))

    def place(batches):
        for batch in batches:
            v, ties, sums = _matrix(batch.column(1)), batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            queries = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for c in range(n_curves):
                block = curves.value.blocks(v, ties, c)
                first = np.clip(block - 1, 0, blocks - window)
                for is_ask, base, some in [(False, block, np.arange(len(v)))] + [(True, first + d, np.flatnonzero(queries)) for d in range(window)]:
                    others, own, mine = (parts, asks, sums[some] % asks) if is_ask else (asks, parts, sums[some] % parts)
                    for j in range(others):  # a query meets every chunk of a block, a candidate every chunk of queries
                        cell = ((c * blocks + base[some]) * parts + (j if is_ask else mine)) * asks + (mine if is_ask else j)
                        moved = batch.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.full(len(some), is_ask)), moved.column(0), moved.column(1), moved.column(2)], ["cell", "ask", "g", "v", "ids"])

    def compare(frame):
        ask = frame["ask"].to_numpy()
        cand, query = frame[~ask], frame[ask]
        if cand.empty or query.empty:
            return pd.DataFrame({"query": pd.Series(dtype=object), "cand": pd.Series(dtype=object), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})
        return _best(cand, query, k + 1)

    placed = (
        folded.join(asked.select("g").distinct().withColumn("q", F.lit(True)), "g", "left")
        .select("g", "v", "ids", tie, F.coalesce("q", F.lit(False)).alias("q"), F.pmod(F.xxhash64(F.lit(3), "g"), F.lit(1 << 30)).alias("chunk"))
        .mapInArrow(place, f"cell long, ask boolean, g string, v {kind}, ids array<long>")
    )
    cells = n_curves * blocks * parts * asks
    found = placed.repartition(max(partitions(spark), min(cells, 4 * partitions(spark))), "cell").groupBy("cell").applyInPandas(compare, "query string, cand string, score double, ids array<long>")
    once = found.groupBy("query", "cand").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = once.select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.groupBy(F.col("query").alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    answers = asked.join(lists, "g").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("at", "hit"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
