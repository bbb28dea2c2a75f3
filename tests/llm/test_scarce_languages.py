"""Rejection where a language has few texts of a length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"
FOREIGN = ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * n for n in (1, 4, 20)] + ["いろはにほへとちりぬるをわかよたれそつねならむ" * n for n in (1, 10)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(SF)
    return langid.fit(docs.where(~langid.held_out("doc_id", 4, 2)))


def test_no_language_accepts_everything(model):
    assert (model.bounds > 0).all()


def test_foreign_scripts_are_rejected_and_own_texts_kept(spark, model):
    docs = spark.read.parquet(SF)
    foreign = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    assert all(r["rejected"] for r in langid.predict(foreign, model).collect())
    kept = langid.predict(docs, model).join(docs.select("doc_id", "text", "lang"), "doc_id").where("text is not null and lang is not null")
    share = kept.agg(F.avg(F.col("rejected").cast("int")), F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert share[0] < 0.005 and share[1] > 0.99


def test_bounds_are_borrowed(monkeypatch):
    monkeypatch.setattr(langid, "ENOUGH", 50)
    grids = np.zeros((2, langid.BANDS, langid.BINS), np.int64)
    grids[0, 3, 256] = 40  # one language has few texts, the other many in two bands
    grids[0, 4, 300] = 20
    grids[1, 3, 128] = 100
    low = lambda place: langid.SLACK * place / langid.BINS
    assert langid.borrowed(grids, 0, 3) == low(128)  # the lower of its own 60 texts and of the band's 140
    assert langid.borrowed(grids, 0, 5) == low(256)  # its own: no language has texts of the band
    assert langid.borrowed(grids[:1, :4] * 1, 0, 0) == low(256)  # too few anywhere: what there is
    assert langid.borrowed(grids * 0, 0, 0) == 0.0


def test_draws_depend_on_texts_alone(spark):
    docs = spark.read.parquet(SF).where("doc_id < 200").select("doc_id", "text", "lang")
    one = langid.fit(docs, sample=20)
    two = langid.fit(docs.withColumn("doc_id", F.col("doc_id") * 7 + 1).unionByName(docs.where("doc_id < 50")), sample=20)
    assert one.languages == two.languages and one.centroids.shape == two.centroids.shape
