"""Exact nearest vectors for a stated set of queries, and their normalisation.

Vectors lie in cells around pivots, each with the greatest distance of its vectors from the pivot, its radius.
The inner product of a query with a vector of a cell is at most that with the pivot plus the query's length
times the radius. So each query first meets its most promising cell, and then only those whose bound
reaches the k-th best score found there. Queries are rows like any others: they are routed to cells, in
packs, and meet the cells' blocks in a join; the driver holds the pivots and radii only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Pivots at most, vectors of a block, queries of a pack.
PIVOTS, ROWS, PACK = 64, 4096, 256
#: Room for the rounding of scores and of bounds.
SLACK = 1e-5
FOUND = "query_id long, vec_id long, score double"


def normalised(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays, null stays null."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def usable(v: Column) -> Column:
    """Whether a vector takes part: it isn't null or empty and holds no null."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def _top(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row, ties to the smaller name; only what reaches the k-th best is sorted."""
    take = min(k, len(names))
    least = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((names[column], -scores[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[kept], column[kept]


def _matrices(batches, names: tuple[str, str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of Arrow batches, those of one length together."""
    for batch in batches:
        ids, lists = batch.column(names[0]).to_numpy(zero_copy_only=False), batch.column(names[1])
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(at)
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            yield ids[some], flat[at[some][:, None] + np.arange(size)]


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (size, cell, ids, body): the vectors (cell, size, id, v) of each cell as matrices of at most ``most`` rows. ``part`` splits large cells."""
    spark = rows.sparkSession

    def run(batches):
        held, ids, vs = None, [], []

        def out():
            body = np.array(vs, np.float64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([body], pa.binary())], ["size", "cell", "ids", "body"])

        for batch in batches:
            flat, at = batch.column("v").values.to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            for i, (size, cell, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "cell", "id")))):
                if ids and ((size, cell) != held or len(ids) == most):
                    yield out()
                    ids, vs = [], []
                held = size, cell
                ids.append(name)
                vs.append(flat[at[i] : at[i + 1]])
        if ids:
            yield out()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a cell that is large, or asked for by many, spreads over tasks
    dealt = rows.repartition(parts, "size", "cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("size", "cell", "id")
    return dealt.select("size", "cell", "id", "v").mapInArrow(run, "size int, cell int, ids binary, body binary")


class Cells:
    """Pivots and radii of the cells, by the vectors' length."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.radii = pivots, {}

    def of(self, size: int) -> np.ndarray:
        """The pivots of a length; one zero vector where it has none."""
        return self.pivots.get(size, np.zeros((1, size)))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot's cell of each vector, and its distance."""
        p = self.of(v.shape[1])
        near = ((p * p).sum(axis=1)[None, :] - 2 * v @ p.T).argmin(axis=1)
        return near, np.linalg.norm(v - p[near], axis=1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The greatest inner product that a vector of each cell can have with each query; cells without vectors have none."""
        size = q.shape[1]
        radii = np.array([self.radii.get((size, c), -np.inf) for c in range(len(self.of(size)))])
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(radii), q @ self.of(size).T + np.linalg.norm(q, axis=1)[:, None] * np.where(np.isfinite(radii), radii, 0), -np.inf)


def build_cells(vectors: DataFrame, pivots: int | None = None) -> tuple[Cells, DataFrame]:
    """The cells of ``vectors`` (vec_id, embedding), and their blocks (size, cell, ids, body) in the shared folder."""
    spark = vectors.sparkSession
    cells = Cells({})
    by: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots or PIVOTS).collect():
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    cells.pivots = {size: np.array(vs, np.float64) for size, vs in by.items()}
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches):
        for ids, v in _matrices(batches, ("vec_id", "embedding")):
            near, far = shared.value.nearest(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v.shape[1]), pa.int32()), pa.array(near, pa.int32()), pa.array(ids, pa.int64()), pa.array(list(v), pa.list_(pa.float64())), pa.array(far)], ["size", "cell", "id", "v", "far"])

    placed = written(vectors.select("vec_id", "embedding").mapInArrow(assign, "size int, cell int, id long, v array<double>, far double"))
    for r in placed.groupBy("size", "cell").agg(F.max("far").alias("far")).collect():  # as many as there are cells
        cells.radii[r["size"], r["cell"]] = r["far"]
    return cells, written(_packed(placed.drop("far"), ROWS))


def _meet(routed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Rows of FOUND: the k best of each pack of queries (size, cell, id, v) in each block of its cell."""

    def run(batches):
        for batch in batches:
            for size, q_ids, q_body, v_ids, v_body in zip(*(batch.column(c).to_pylist() for c in ("size", "q_ids", "q_body", "ids", "body"))):
                asked, names = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
                score = np.round(np.frombuffer(q_body).reshape(-1, size) @ np.frombuffer(v_body).reshape(-1, size).T, 6)
                row, column = _top(score, names, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(names[column]), pa.array(score[row, column])], ["query_id", "vec_id", "score"])

    packs = _packed(routed, PACK).withColumnRenamed("ids", "q_ids").withColumnRenamed("body", "q_body")
    return packs.join(blocks, ["size", "cell"]).select("size", "q_ids", "q_body", "ids", "body").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def routes(queries: DataFrame, cells: Cells, least: bool) -> DataFrame:
    """Rows (size, cell, id, v): each query (query_id, q) with its most promising cell; or, with ``least``, with the others that can hold a score of ``threshold`` or more."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            limits = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())) if least else {}
            for ids, q in _matrices([batch], ("query_id", "q")):
                bounds = shared.value.bounds(q)
                first = bounds.argmax(axis=1)
                if least:
                    limit = np.array([-np.inf if limits[i] is None else limits[i] for i in ids.tolist()])
                    wanted = (bounds >= limit[:, None] - SLACK * (1 + np.abs(limit[:, None]))) & np.isfinite(bounds)
                    wanted[np.arange(len(ids)), first] = False
                    row, cell = np.nonzero(wanted)
                else:
                    row, cell = np.arange(len(ids)), first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), q.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(ids[row], pa.int64()), pa.array(list(q[row]), pa.list_(pa.float64()))], ["size", "cell", "id", "v"])

    return queries.mapInArrow(run, "size int, cell int, id long, v array<double>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k vectors with the largest inner product, the query itself included, ties to the smaller id.

    Vectors that are null or hold a null take no part; a query meets the vectors of its own length. Queries
    are told by their ids; scores have six digits.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_asked")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    queries = rows.where("_asked").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q")).dropDuplicates(["query_id"])
    cells, blocks = build_cells(rows.drop("_asked").withColumn("vec_id", F.col("vec_id").cast("long")))
    first = written(_best(_meet(routes(queries, cells, False), blocks, k), k))
    limits = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    rest = _meet(routes(queries.join(limits, "query_id", "left").select("query_id", "q", "threshold"), cells, True), blocks, k)
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def with_metadata(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ranked vectors with what the index says of them (vec_id and other columns but the embedding); scores of four digits."""
    known = metadata.drop("embedding")
    return found.join(known, "vec_id").withColumn("similarity_score", F.round("score", 4)).drop("score")
