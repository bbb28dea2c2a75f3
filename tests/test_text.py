"""Grammars, keys and similarities on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import similarity, text

IDS = {
    "XY124": "XY124", "XY 124": "XY124", "4/102": "4/102", "4 of 102": "4/102", "SV124/198": "SV124/198", "TG01/TG30": "TG01/TG30", "SV01a": "SV01A", "SVP 035": "SVP035",
    "SVP035": "SVP035", "[SVP EN] 035": "SVP035", "G [SVP EN] 035": "SVP035", "SVPE 035": "SVP035", "SWSH 050": "SWSH050", "SWSH050": "SWSH050", "SM210": "SM210", "151/165": "151/165",
    "X0124": "XY124", "XY I24": "XY124", "S5050": "SWSH050", "5VP 035": "SVP035", "SVP O35": "SVP035",
    "ILLUSTRATOR KEN SUGIMORI": None, "FOIL NOISE 12345": None, "RANDOM JUNK TEXT": None, "": None,
}
COLLECTOR = {"ILLUSTRATOR TG01/TG30": "TG01/TG30", "SECRET GG12/GG70": "GG12/GG70", "PROMO SVP025": "SVP025", "SWSH 050": "SWSH050", "199/165": "199/165", "251/198": "251/198", None: None}


def _one(spark, rows, make):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return {r[0]: r[1] for r in df.select("s", make(F.col("s")).alias("x")).collect()}


def test_printed_ids(spark):
    got = _one(spark, IDS, lambda s: text.printed_id(s)["id"])
    assert got == IDS


def test_collector_ids(spark):
    assert _one(spark, COLLECTOR, text.collector_id) == COLLECTOR


def test_hp_and_totals(spark):
    assert _one(spark, ["05240", "350 HP", "hp 90 x", "52 HP", "", None], text.hp) == {"05240": 240, "350 HP": 350, "hp 90 x": 90, "52 HP": None, "": None, None: None}
    assert _one(spark, ["165", "056", "190", "068", "777", "158"], text.set_total) == {"165": "165", "056": "086", "190": "198", "068": "068", "777": "777", "158": "188" if "188" in text.TOTAL_TARGETS else "158"}


def test_number_keys(spark):
    got = _one(spark, ["007", "TG1", "svp-7", "", None], text.number_keys)
    assert got["007"] == ["007", "7"] and "TG01" in got["TG1"] and "SVP007" in got["svp-7"] and got[""] == [] and got[None] == []


@pytest.mark.parametrize(("a", "b", "want"), [("mewe", "mew ex", 80), ("mew", "mewtwo", 67), ("same", "same", 100), ("", "x", 0), ("abcab", "ababc", 80)])
def test_ratio(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    row = df.select(similarity.ratio(x, y).alias("r"), similarity.ratio(y, x).alias("back"), similarity.token_set_ratio(x, y).alias("t"), similarity.partial_ratio(x, y).alias("p")).first()
    assert row["r"] == row["back"] == want and 0 <= row["t"] <= 100 and row["p"] >= (0 if not a else want if a == b else 0)


def test_matching_blocks_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in df.select(similarity.matching_blocks("a", "b")).collect()] == [0.25, 0.5]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _ratio(a, b):
    return 0 if not a or not b else 100 if a == b else round(200.0 * _common(a, b) / (len(a) + len(b)))


def test_ratios_equal_the_table(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé x") for _ in range(n))
    rows = [(word(rng.randint(0, 14)), word(rng.randint(0, 14))) for _ in range(150)] + [("a" * 70, "ab" * 50), ("ab" * 31, "ba" * 40), ("x" * 63, "x" * 62), ("日本語", "本日語")]
    x, y = F.col("a"), F.col("b")
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.ratio(x, y).alias("r"), similarity.partial_ratio(x, y).alias("p")).collect():
        short, long = sorted((r["a"], r["b"]), key=len)
        assert r["r"] == _ratio(r["a"], r["b"])
        assert r["p"] == (max(_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)) if short else 0)


@pytest.mark.parametrize("least", [0.645, 0.45])
def test_alike_pairs_lose_none(spark, least):
    rng = random.Random(2)
    names = [sorted({"".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 12))) for _ in range(80)}) for _ in range(2)]
    left, right = (spark.createDataFrame([(n,) for n in some], f"{c} string") for some, c in zip(names, "ab"))
    got = {(r["a"], r["b"]) for r in similarity.alike_pairs(left, right, "a", "b", least).collect()}
    want = {(a, b) for a in names[0] for b in names[1] if a and b and 2 * _common(a, b) >= least * (len(a) + len(b))}
    assert want <= got and len(got) < len(names[0]) * len(names[1])


def test_totals_of_the_catalogue_stay(spark):
    df = spark.createDataFrame([("156", ["156", "200"]), ("156", ["200"]), ("156", None)], "t string, known array<string>")
    assert [r[0] for r in df.select(text.set_total(F.col("t"), F.col("known"))).collect()] == ["156", "186", "186"]
