"""Language identification by nearest centroids.

A text becomes a vector of byte n-grams (2 and 3 bytes of lower-cased letters, all else one space),
hashed to a fixed number of buckets, weighted by log-frequency times inverse document frequency and
normalised. Each language has several centroids, found by spherical k-means on its training vectors,
so that differing kinds of text do not blur into one mean. The language of the nearest centroid by
cosine is predicted; a text whose cosine to it is below that language's rejection bound is rejected.
Short texts lie further from any centroid than long ones, so each language has a bound for each band
of text lengths: ``SLACK`` times the ``LOW`` quantile of the cosines that training texts of the band
have to their own language. So a few odd training texts decide nothing, and only what is clearly
further off than nearly all of them is turned away. A band with fewer than ``ENOUGH`` texts of a
language takes the next shorter band's bound, or where all shorter ones have too few as well the lower
of two pooled ones: of the language's texts of any length, and of all languages' texts of the band.

Document frequencies and bounds come from all training documents. The centroids are fitted on a
bounded sample: ``SAMPLE`` distinct texts of each language at most, chosen by a hash of the text.

Defined results: texts that are null or have no letter are ``und`` with score 0 and rejected; without
training rows every text is; equal scores go to the language that sorts first; repeated rows each get
their row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, utf8

#: Buckets of the vectors, rows of a block of vectors, documents of a language that centroids are fitted on at most, centroids of a language.
BUCKETS, ROWS, SAMPLE, CENTROIDS = 4096, 512, 300, 4
#: Bands of length (by powers of two of the letters), bins of a cosine, quantile and slack of the rejection bound, texts that a band needs, share of a language's texts that a centroid needs.
BANDS, BINS, LOW, SLACK, ENOUGH, STRAY = 16, 512, 0.001, 0.75, 50, 0.05
UNKNOWN = "und"
#: Letters in lower case (bytes beyond ASCII as they are); all else is a space.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of n-gram counts for each text, given as joined UTF-8 bytes and offsets."""
    rows = len(at) - 1
    total = np.zeros(rows * BUCKETS, np.float32)
    x = _LETTERS[data]
    text = np.repeat(np.arange(rows), np.diff(at))
    if len(x) > 1:
        pair = (x[:-1] << 8) | x[1:]
        triple = ((pair[:-1] << 8) | x[2:]) ^ np.uint32(1 << 25)
        for code, n in ((pair, 2), (triple, 3)):
            inside = text[: len(code)] == text[n - 1 :]
            bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            total += np.bincount((text[: len(code)] * BUCKETS + bucket)[inside], minlength=len(total)).astype(np.float32)
    return total.reshape(rows, BUCKETS)


def vectors(data: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors."""
    v = np.log1p(counts(data, at)) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def bands(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band of each text: the power of two of its letters' bytes."""
    letters = np.concatenate([[0], np.cumsum(_LETTERS[data] != 32)])
    return np.minimum(np.log2(letters[at[1:]] - letters[at[:-1]] + 1).astype(np.int64), BANDS - 1)


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def _blocks(batches, text: int, name: str):
    """Pieces of batches of few rows and bounded text."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            yield from slices(whole.slice(k, ROWS), name, 1 << 20)


@dataclass
class Model:
    """Centroids (rows) with their languages, weights of buckets, and rejection bounds by centroid and band."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray

    def scores(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and the cosine, from 0 to 1."""
        cosine = v @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(v)), best].astype(np.float64), 0, 1)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, started from the means of equal slices along the direction of largest variance.

    A centroid that few vectors are nearest to stands for stray texts and not for the language; it goes.
    """
    along = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)[0][:, 0]
    c = np.array([v[part].mean(axis=0) for part in np.array_split(np.argsort(along, kind="stable"), min(k, len(v)))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                mean = v[near == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    share = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c)) / len(v)
    return c[share >= min(STRAY, share.max())]


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the text and language of ``training``; rows without either are left out."""
    rows = training.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches):
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in _blocks(batches, 0, "text"):
            df += (counts(*utf8(batch.column(0))) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(-1, BUCKETS), pa.int32()), "n": pa.array(np.append(n, df), pa.int64())})

    found = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"].to_numpy() + 1] = found["n"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}  # one row for each language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), idf, np.zeros((0, BANDS)))
    draw = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))) * F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("lang"))

    def embed(batches):
        for batch in _blocks(batches, 1, "text"):
            v = vectors(*utf8(batch.column(1)), idf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())], ["lang", "v"])

    # about sample distinct texts a language are drawn, by a hash of the text alone; of repeated ones one row stays before rows are exchanged
    few = Window.partitionBy("lang").orderBy("d")
    drawn = rows.withColumn("d", draw).where(F.col("d") < sample).dropDuplicates(["lang", "d"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= sample)
    chosen = drawn.select("lang", "text").mapInArrow(embed, "lang string, v binary").toArrow().to_pandas()  # sample rows a language at most
    languages, centroids = [], []
    for lang, group in chosen.groupby("lang", sort=True):
        v = np.array([np.frombuffer(x, np.float16) for x in sorted(group["v"])]).astype(np.float32)
        v = v[np.linalg.norm(v, axis=1) > 0]
        if not len(v):
            continue
        c = cluster(v, CENTROIDS)
        languages += [lang] * len(c)
        centroids.append(c)
    model = Model(languages, np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), idf, np.zeros((len(languages), BANDS)))
    model.bounds = rejection_bounds(rows, model)
    return model


def rejection_bounds(rows: DataFrame, model: Model) -> np.ndarray:
    """The bound of each centroid's language in each band, from the cosines of all ``rows`` (lang, text) to their own language."""
    names = sorted(set(model.languages))
    own = {name: np.flatnonzero(np.array(model.languages) == name) for name in names}
    shared = rows.sparkSession.sparkContext.broadcast((model, own))

    def spread(batches):
        model, own = shared.value
        seen = np.zeros((len(own), BANDS, BINS), np.int64)
        for batch in _blocks(batches, 1, "text"):
            data, at = utf8(batch.column(1))
            cosine, band = vectors(data, at, model.idf) @ model.centroids.T, bands(data, at)
            lang = np.array(batch.column(0).to_pylist(), object)
            for k, (name, columns) in enumerate(own.items()):
                mine = np.flatnonzero(lang == name)
                best = np.clip(cosine[np.ix_(mine, columns)].max(axis=1) * BINS, 0, BINS - 1).astype(np.int64) if len(mine) else mine
                np.add.at(seen, (k, band[mine], best), 1)
        cell = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen.ravel()[cell])], ["cell", "n"])

    bounds = np.zeros((len(model.languages), BANDS))
    if not names:
        return bounds
    counted = rows.select("lang", "text").mapInArrow(spread, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x BANDS x BINS rows at most
    seen = np.zeros(len(names) * BANDS * BINS, np.int64)
    seen[counted["cell"].to_numpy(np.int64)] = counted["n"]
    grids = seen.reshape(len(names), BANDS, BINS)
    for k, grid in enumerate(grids):
        known = None
        for band in range(BANDS):
            if grid[band].sum() >= ENOUGH:
                known = _low(grid[band])
            bounds[own[names[k]], band] = known if known is not None else borrowed(grids, k, band)
    return bounds


def _low(grid: np.ndarray) -> float:
    """The bound that a histogram of cosines gives."""
    return SLACK * int(np.searchsorted(np.cumsum(grid), LOW * grid.sum(), side="right")) / BINS


def borrowed(grids: np.ndarray, k: int, band: int) -> float:
    """The bound of a language that has too few texts up to a band.

    That of all its lengths or of all languages' texts in the band, whichever is lower; only where both
    are too few as well, that of whatever there is.
    """
    pools = [grids[k].sum(axis=0), grids[:, band].sum(axis=0)]
    able = [_low(x) for x in pools if x.sum() >= ENOUGH] or [_low(x) for x in (pools[0], grids.sum(axis=(0, 1))) if x.sum()]
    return min(able, default=0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, rejected), from the text alone."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x languages x BUCKETS numbers

    def run(batches):
        for batch in _blocks(batches, 1, text_col):
            names, score, rejected = _judge(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, lang_pred string, score double, rejected boolean")


def _judge(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, at = utf8(column)
    raw = data.tobytes()
    letters = np.array([has_letter(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], bool)
    if not model.languages:
        return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
    best, score = model.scores(vectors(data, at, model.idf))
    score = np.where(letters, score, 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], score, ~letters | (score < model.bounds[best, bands(data, at)])


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns; judged in place, without a shuffle.

    Where ``lang_col`` is named, its nulls are filled with the predicted language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if lang_col else None

    def run(batches):
        for batch in _blocks(batches, place, text_col):
            names, _, rejected = _judge(batch.column(place), shared.value)
            if lang is not None:
                filled = pc.coalesce(batch.column(lang), pa.array(names, batch.schema.field(lang).type))
                batch = batch.set_column(lang, batch.schema.field(lang), filled)
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a document belongs to the fold, by the checksum of its id as text; null ids belong to none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def evaluate(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Fits on all folds but one and predicts every document: rows (id, held_out, lang_pred, score, rejected)."""
    model = fit(docs.where(~held_out(id_col, folds, fold)), id_col)
    return predict(docs, model, id_col).select(id_col, held_out(id_col, folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
