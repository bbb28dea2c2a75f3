"""Ranking, abstention, consensus and votes on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import boxes, consensus, quality, scoring
from attestor.sources import cards as sources
from attestor.streaming.voter import stream_votes

CARDS = "k long, id string, name string, hp string, number string, set_id string, set_name string, printed_total int"
SCANS = "scan_id long, collector_id string, ocr_name string, ocr_hp int"
MEW, MEWTWO = (0, "a-151", "Mew ex", "180", "151", "a", "151", 165), (1, "b-151", "Mewtwo", "120", "151", "b", "Other", 198)


@pytest.mark.parametrize(
    ("cards", "scan", "score", "verified"),
    [([MEW, MEWTWO], ("151/165", "Mewe", 180), 95.0, True), ([MEW], (None, "Mew ex", 180), 40.0, False), ([MEW], ("151/165", None, None), 60.0, False), ([MEW], (None, None, None), 0.0, False)],
)
def test_verify(spark, cards, scan, score, verified):
    scans = spark.createDataFrame([(1, *scan)], SCANS)
    got = scoring.decide(scans, scoring.evidence(scans, spark.createDataFrame(cards, CARDS))).first()
    assert (got["best_score"], got["verified"]) == (score, verified)


def test_modal_and_consensus(spark):
    rows = spark.createDataFrame([(1, 1, "Mewe"), (1, 2, "Mew ex"), (1, 3, "Mew ex"), (2, 1, "Abra"), (3, 1, None)], "g long, n int, v string")
    assert {r["g"]: (r["mode"], r["n"]) for r in consensus.modal(rows, "g", "v", "n").collect()} == {1: ("Mew ex", 2), 2: ("Abra", 1)}
    got = {r["g"]: (r["name"], r["agreement"]) for r in consensus.name_consensus(rows, "g", "v", "n").collect()}
    assert got[1][0] == "Mew ex" and got[2] == ("Abra", 1.0) and 3 not in got


def test_gate(spark):
    rows = [(60.0, 0.0, 0.5, True, 0.0, 0.0), (100.0, 0.0, 0.5, True, 0.95, 0.0), (300.0, 0.09, 0.5, True, 0.0, 0.0), (300.0, 0.05, 0.5, True, 0.0, 0.99), (300.0, 0.0, 0.05, False, 0.0, 0.0), (350.0, 0.0, 0.5, True, None, None)]
    got = quality.gate(spark.createDataFrame(rows, "lap double, glare double, area double, card_like boolean, ml_blurry double, ml_glare double")).collect()
    assert [r["reason"] for r in got] == ["blurry", "probably blurry", "glare", "probably glare", "no card", None] and got[-1]["quality"] == 100.0


def test_votes_batch_equals_stream(spark, tmp_path):
    rows = [(s, n, f"XY{n % 3}" if n % 7 else None, 0.5 + n % 4 / 10, 40.0 + n % 20) for s in (1, 2) for n in range(40)]
    schema = "session long, seq long, printed_id string, confidence double, frame_quality double"
    votes = spark.createDataFrame(rows, schema)
    votes.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_votes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("votes_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r["session"], r["seq"])
    assert sorted(spark.table("votes_out").collect(), key=key) == sorted(consensus.history_vote(votes).collect(), key=key)


def test_three_equal_votes_are_accepted(spark):
    votes = spark.createDataFrame([(1, n, "XY124", 0.9, 80.0) for n in (1, 2, 3)], "session long, seq long, printed_id string, confidence double, frame_quality double")
    rows = consensus.history_vote(votes).orderBy("seq").collect()
    assert [(r["printed_id"], r["confidence"], r["status"]) for r in rows] == [(None, 0.0, "rejected"), ("XY124", 0.5, "ambiguous"), ("XY124", 0.9, "accepted")]


def test_name_by_size(spark):
    tokens = [(1, 0, "Mew", 0.0, 50.0, 0.0, 40.0), (1, 1, "ex!", 55.0, 80.0, 10.0, 30.0), (1, 2, "Basic", 0.0, 40.0, 0.0, 60.0), (1, 3, "faraway", 900.0, 950.0, 0.0, 40.0)]
    got = boxes.name_by_size(spark.createDataFrame(tokens, "scan_id long, ord int, text string, x1 double, x2 double, y1 double, y2 double")).collect()
    assert [r["name"] for r in got] == ["Mew ex"]


def test_catalog_reader(spark, tmp_path):
    body = '[{"id": "x-1", "name": "Mew", "hp": "60", "set": {"id": "x", "printedTotal": 10}}]'
    (tmp_path / "bare.json").write_text(body)
    (tmp_path / "whole.json").write_text('{"cards": ' + body + "}")
    for name in ("bare", "whole"):
        assert sources.read_catalog(spark, str(tmp_path / f"{name}.json")).select("id", "set.printedTotal").collect() == [("x-1", 10)]
    assert sources.read_catalog(spark, str(tmp_path / "absent.json")).count() == 0


def test_name_by_size_equals_a_loop(spark):
    from attestor.functions import text

    rng = random.Random(5)
    words = ["Mew", "ex", "Basic", "Char", "izard", "VMAX", "12", "aa", "Tera"]
    rows = [(s, n, rng.choice(words), x := rng.uniform(0, 300), x + rng.uniform(5, 80), y := rng.uniform(0, 40), y + rng.choice([10.0, 20.0, 40.0])) for s in range(60) for n in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "scan_id long, ord int, text string, x1 double, x2 double, y1 double, y2 double")
    got = {r["scan_id"]: r["name"] for r in boxes.name_by_size(df).collect()}
    kept = {r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").where(text.names_something(text.name_token(F.col("w")))).collect()}
    want = {}
    for s in range(60):
        tokens = sorted((r for r in rows if r[0] == s and r[2] in kept), key=lambda r: (-(r[6] - r[5]), r[1]))
        if not tokens:
            continue
        first, taken = tokens[0], tokens[:1]
        for r in tokens[1:]:
            gap = min(max(r[3] - a[4], a[3] - r[4], 0) / max(a[4] - a[3], 1) for a in taken)
            tall = first[6] - first[5]
            alike = r[6] - r[5] >= tall * 0.55 and abs((r[5] + r[6]) / 2 - (first[5] + first[6]) / 2) < tall * 0.9
            if gap <= 2.5 and (r[2].lower() in text.NAME_SUFFIXES or alike):
                taken.append(r)
        want[s] = " ".join(r[2] for r in sorted(taken, key=lambda r: ((r[3] + r[4]) / 2, -(r[6] - r[5]), r[1])))
    assert got == want
