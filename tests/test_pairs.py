"""Pairs of scans and cards are made once each, without being exchanged or compared with each other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestor.functions import similarity
from attestor.operators import candidates, consensus, contenders, scoring
from tests.test_contenders import odd_rows

CARDS = "k long, id string, name string, hp string, number string, set_id string, set_name string, printed_total int"
SCANS = "scan_id long, collector_id string, ocr_name string, ocr_hp int"


def nodes_above_join(df):
    """Names of the operators of the optimized plan before the first join."""
    lines = [x.strip(" :+-") for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    names = [x.split(" ")[0] for x in lines]
    return names[: names.index("Join")]


def test_pairs_by_number_are_final_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(candidates, "PAIRS", 50)
    monkeypatch.setattr(candidates, "SCANS", 5)
    cards = [(i, f"c{i % 70}", "Mew", "60", str(i % 4 + 1), "a", "A", 100) for i in range(90)]  # some ids twice, with other numbers
    scans = [(i % 50, f"{i % 5 + 1}/100", "Mew", 60) for i in range(80)]
    found = candidates.by_number(spark.createDataFrame(scans, SCANS), spark.createDataFrame(cards, CARDS))
    assert set(nodes_above_join(found)) <= {"Project", "Filter"}
    got = sorted((r["scan_id"], r["id"]) for r in found.collect())
    assert got == sorted({(s[0], c[1]) for s in scans for c in cards if s[1].split("/")[0] == c[4]})


@pytest.mark.parametrize("twice", [False, True])
def test_evidence_is_made_where_pairs_are(spark, twice):
    """Pairs are neither exchanged nor compared; repeated ids, which take that, give the same rows."""
    cards, scans = odd_rows(7, 150, 80)
    scans = [*scans, *scans[:1]] if twice else scans
    cards, scans = spark.createDataFrame(cards, CARDS), spark.createDataFrame(scans, SCANS)
    found = scoring.evidence(scans, cards)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert bool(re.search(r"Aggregate \[[^\]]*\bscan_id#[^\]]*\bid#", plan)) == twice
    columns = ["scan_id", "id", "name", "number", *scoring.SCORES]
    want = scoring.evidence(scans, cards, candidates.candidates(scans, cards))
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(found) == rows(want) and len(rows(found)) > 1000


def test_few_cards_of_a_root_and_total_are_read(spark):
    """3000 cards share name and total; a scan with a number and hp reads those that can be among its best."""
    cards = [(i, f"c{i:05d}", "Mew ex", str(i % 38 * 10 + 30), str(i % 300 + 1), "a", "A", 100) for i in range(3000)]
    scans = [(i, f"{i * 7 % 300 + 1}/100", "Mew", i % 38 * 10 + 30) for i in range(30)]
    first, more = contenders.contenders(spark.createDataFrame(scans, SCANS), spark.createDataFrame(cards, CARDS))
    assert first.count() + more.count() < 40 * len(scans)


def test_alike_in_python_is_that_of_columns(spark):
    rng = random.Random(3)
    words = ["mew", "ex", "mr. mime", "", " ", "é", "charizard", "char-izard", "gx", "12", "x" * 70]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", F.greatest(similarity.ratio(a, b), similarity.token_set_ratio(a, b)).alias("s")).collect():
        assert r["s"] == similarity.alike(r["a"], r["b"]), r


@pytest.mark.parametrize("similar", [None, similarity.matching_blocks])
def test_groups_of_few_names_are_judged_without_exchanging_pairs(spark, monkeypatch, similar):
    rng = random.Random(4)
    names = ["Mew ex", "Mewe", "MEW EX", "Mew", "12", "", "Abra", "Kadabra v", "Mew VMAX", None]
    rows = spark.createDataFrame([(g, n, rng.choice(names)) for g in range(60) for n in range(rng.randint(1, 7))], "g long, n long, v string")
    monkeypatch.setattr(consensus, "FEW", 0)
    want = sorted(map(str, consensus.name_consensus(rows, "g", "v", "n", similar).collect()))  # all by pairs
    monkeypatch.setattr(consensus, "FEW", 3)
    assert sorted(map(str, consensus.name_consensus(rows, "g", "v", "n", similar).collect())) == want and len(want) > 50
    monkeypatch.setattr(consensus, "_consensus_by_pairs", lambda names, group, similar: names.limit(0).select(group, "name", F.lit(0.0).alias("agreement")))
    monkeypatch.setattr(consensus, "FEW", 64)
    assert sorted(map(str, consensus.name_consensus(rows, "g", "v", "n", similar).collect())) == want
