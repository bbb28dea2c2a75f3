"""The remote catalogue: filters become searches, answers are kept, failures aren't."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from attestor.sources.remote import remote_cards


@pytest.fixture
def catalogue(spark, tmp_path, monkeypatch):
    here = os.path.dirname(os.path.abspath(__file__))
    spark.sparkContext.addPyFile(os.path.join(here, "fake_catalogue.py"))
    sys.path.insert(0, here)
    if os.path.exists("/tmp/fake_catalogue.log"):
        os.truncate("/tmp/fake_catalogue.log", 0)
    yield remote_cards(spark, "fake_catalogue:search", wait="0", cache=f"file://{tmp_path}/answers")
    sys.path.remove(here)


def calls():
    return open("/tmp/fake_catalogue.log").read().split("\n")[:-1] if os.path.exists("/tmp/fake_catalogue.log") else []


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_are_pushed(catalogue):
    mew = catalogue.where("name = 'Mew ex' and hp = '180'")
    plan = mew._jdf.queryExecution().executedPlan().toString()
    assert "hp" in plan.split("Filter")[1].split("\n")[0] and "Mew ex" not in plan.split("Filter")[1].split("\n")[0]
    assert ids(mew) == ["a-1"] and set(calls()) == {"name=Mew ex"}
    assert ids(catalogue.where(F.col("number") == "151")) == ["a-1", "b-2"]
    assert ids(catalogue.where(F.col("name").startswith("Mew") & (F.col("number") != "4"))) == ["a-1", "b-2"]
    assert ids(catalogue.where(F.col("name").isin("Mewtwo", "Charizard", "mew EX"))) == ["b-2", "c-3"]


def test_answers_are_kept_and_failures_are_not(catalogue):
    for _ in range(2):
        found = catalogue.where("name = 'Charizard'").select("tcgplayer.prices", "id").collect()
        assert [(r["id"], r["prices"]["normal"]["market"]) for r in found] == [("c-3", 1.5)]
        assert ids(catalogue.where("name = 'down'")) == []
        assert ids(catalogue.where("number = '999'")) == []
    assert (calls().count("name=Charizard"), calls().count("name=down"), calls().count("number=999")) == (3, 6, 1)


def test_listing_is_refused(catalogue):
    with pytest.raises(Exception, match="only searched"):
        catalogue.collect()
