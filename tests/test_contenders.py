"""The threshold search gives the full ranking's best, ties included, from fewer pairs."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import text
from attestor.operators import candidates, contenders, scoring
from attestor.sources.fixtures import view

CARDS = "k long, id string, name string, hp string, number string, set_id string, set_name string, printed_total int"
SCANS = "scan_id long, collector_id string, ocr_name string, ocr_hp int"
COLUMNS = ["scan_id", "place", "id", "final_score", "n_evidence", "strong", "set_identity"]


def odd_rows(seed, n_cards=400, n_scans=250):
    """Few names, numbers and totals, so that all rules and many ties occur."""
    rng = random.Random(seed)
    pick = rng.choice
    names = ["Mew", "Mew ex", "Mewtwo", "mew VMAX", "Charizard", "Charizard-EX", "ex", "Mr. Mime", "12", "", None, "Char", "Charmander gx"]
    numbers = ["1", "01", "001", "11", "21", "45", "045", "TG05", "TG5", "SVP35", "35", "SWSH35", "XY1", "XY-1", "PROMO", "", "0", "00", None, "A", "4A5", " 45 "]
    totals = [None, 10, 11, 12, 14, 100, 101, 104, 110, 165, -104]
    sets = [None, "a", "svp", "swshp", "xTG", "sma", "xy1", "hsp"]
    cards = [(i, f"c{rng.randint(0, 10**6):07d}-{i}", pick(names), pick([None, "", "60", "120", "0", "x"]), pick(numbers), pick(sets), pick([None, "Base", "Promo pack"]), pick(totals)) for i in range(n_cards)]
    ids = [None, "", "/", "/165", "45", "045/100", "45/", "45/101", "45/0104", "TG05/TG30", "tg5/100", "SVP35", "SVP35/100", "1/10", "11/11", "PROMO", "PROMO/104", "0/12", "35/9104", "A/14", "4a5/x", "SWSH35/104", "XY1/10", "45/12345678901234567890"]
    scans = [(i, pick(ids), pick([*names, "Mewe", "Charizrd", "CHARIZARD", "Me"]), pick([None, 0, 60, 120, 90])) for i in range(n_scans)]
    return cards, scans


@pytest.mark.parametrize("seed,most", [(1, 5), (2, 1)])
def test_best_are_those_of_the_full_ranking(spark, seed, most):
    cards, scans = odd_rows(seed)
    cards, scans = spark.createDataFrame(cards, CARDS), spark.createDataFrame(scans, SCANS)
    key = lambda r: (r["scan_id"], r["place"])
    got = sorted(scoring.ranked(contenders.best_evidence(scans, cards, most), most).select(COLUMNS).collect(), key=key)
    want = sorted(scoring.ranked(scoring.evidence(scans, cards), most).select(COLUMNS).collect(), key=key)
    assert got == want and len(got) > 100


def test_few_pairs_are_read(spark):
    scans, cards = (view(spark, "/root/testdata/sf0.01", n) for n in ("scans", "cards"))
    first, more = contenders.contenders(scans, cards)
    read = first.select("scan_id", "id").unionByName(more)
    everything = candidates.candidates(scans, cards)
    assert read.join(everything, ["scan_id", "id"], "left_anti").count() == 0
    assert read.count() < 0.6 * everything.count()


def test_copies_of_a_card_enter_the_index_once(spark):
    """A thousand cards that differ in their ids alone are read as five."""
    cards = spark.range(1000).select(F.col("id").alias("k"), F.format_string("c-%04d", "id").alias("id"), *(F.lit(v).alias(c) for c, v in (("name", "Mew ex"), ("hp", "60"), ("number", "45"), ("set_id", "a"), ("set_name", "A"))), F.lit(100).alias("printed_total"))
    scans = spark.createDataFrame([(1, "45/100", "Mew", 60), (2, None, "Mew", None), (3, "45/101", None, 70)], SCANS)
    first, more = contenders.contenders(scans, cards)
    assert first.select("scan_id", "id").unionByName(more).distinct().count() == 15
    best = scoring.ranked(contenders.best_evidence(scans, cards), 5)
    assert {r["scan_id"]: r["ids"] for r in best.groupBy("scan_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()} == {s: [f"c-{i:04d}" for i in range(5)] for s in (1, 2, 3)}


def test_one_number_key_stands_for_all(spark):
    values = ["1", "01", "001", "TG05", "TG5", "5", "SV-P35", "35", "PROMO", "", "0", "00", "A", "4A5", "45", " 45 ", "XY 1", "0035", "promo", None]
    rows = spark.createDataFrame([(v, s) for v in values for s in ("a", "svp", "xtg", "sma")], "v string, s string")
    made = rows.select("v", F.array_union(text.number_keys(F.col("v")), text.alias_keys(F.col("s"), F.col("v"))).alias("many"), text.number_key(F.col("v")).alias("one")).collect()
    asked = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.number_keys(F.col("v")).alias("many"), text.number_key(F.col("v")).alias("one")).collect()
    for a in asked:
        for c in made:
            assert (a["one"] is not None and a["one"] == c["one"]) == bool(set(a["many"]) & set(c["many"])), (a, c)


def test_scans_with_any_candidate(spark):
    cards, scans = odd_rows(5, 60, 250)
    cards, scans = spark.createDataFrame(cards, CARDS), spark.createDataFrame(scans, SCANS)
    assert {r[0] for r in candidates.with_any(scans, cards).collect()} == {r[0] for r in candidates.candidates(scans, cards).select("scan_id").distinct().collect()}
