"""Readers, writers, connectors and answers on hand-made files and rows."""

import json
import os
import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import boxes, candidates, quality, scoring, vectors
from attestor.plans import registry
from attestor.sources import cards as sources

CARDS = "k long, id string, name string, hp string, number string, set_id string, set_name string, printed_total int, rarity string, holofoil double, normal double, reverse_holofoil double, first_edition double"
SCANS = "scan_id long, collector_id string, ocr_name string, ocr_hp int"
MEW = (0, "a-151", "Mew ex", "180", "151", "a", "151", 165, "Rare", None, 0.0, 4.5, 9.0)
MEWTWO = (1, "b-151", "Mewtwo", "120", "151", "b", "Other", None, None, None, None, None, None)


def png(width, height):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes([200, 100, 50] * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_and_listing(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2))
    (tmp_path / "b.JPG").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("no image")
    rows = sources.read_images(spark, str(tmp_path)).collect()
    assert [(r["width"], r["height"], r["nChannels"], bytes(r["data"][:3])) for r in rows] == [(3, 2, 3, bytes([50, 100, 200]))]
    got = [(r["name"], r["size_bytes"]) for r in sources.listing(spark, str(tmp_path)).collect()]
    assert got == [("a.png", len(png(3, 2))), ("b.JPG", 12)]
    tables = {(r["name"], r["size_bytes"]) for r in registry.QUERIES["q42_file_listing"](spark, "/root/testdata/sf0.001").collect()}
    assert tables == {(n, os.path.getsize(f"/root/testdata/sf0.001/{n}")) for n in os.listdir("/root/testdata/sf0.001") if n.endswith(".parquet")}


def test_uploads(spark):
    rows = [(1, b"x"), (1, b""), (1, b"y" * 50), *[(2, b"z")] * 3, (3, None)]
    got = sources.uploads(spark.createDataFrame(rows, "burst_id long, content binary"), most_bytes=40, most_frames=2).collect()
    assert [(r["burst_id"], bytes(r["content"])) for r in got] == [(1, b"x")]


def test_card_files_keep_their_own_set(spark, tmp_path):
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "s1.json").write_text(json.dumps([{"id": "s1-2", "name": "B"}, {"id": "s1-1", "name": "A", "set": {"id": "own", "name": "Own"}}]))
    (tmp_path / "cards" / "s2.json").write_text(json.dumps([{"id": "s2-1", "name": "C"}]))
    (tmp_path / "sets.json").write_text(json.dumps([{"id": "s1", "name": "One", "printedTotal": 9}]))
    got = {r["id"]: r["set"] and (r["set"]["id"], r["set"]["name"], r["set"]["printedTotal"]) for r in sources.read_card_files(spark, str(tmp_path / "cards"), str(tmp_path / "sets.json")).collect()}
    assert got == {"s1-1": ("own", "Own", None), "s1-2": ("s1", "One", 9), "s2-1": None}


def test_catalogue_is_replaced_as_a_whole(spark, tmp_path):
    where = str(tmp_path / "catalogue")
    for n in (2, 3):
        sources.write_catalog(spark.range(n), where)
        assert sources.read_written(spark, where).count() == n
    with pytest.raises(Exception):
        sources.write_catalog(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), where)
    assert sources.read_written(spark, where).count() == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    where = str(tmp_path / "catalogue")
    assert sources.last_version(spark, where) is None
    sources.write_catalog(spark.range(1), where)
    seen = sources.last_version(spark, where)
    with ThreadPoolExecutor(4) as pool:
        futures = [pool.submit(sources.write_catalog, spark.range(n), where, seen) for n in (10, 11, 12, 13)]
    won = [f.result() for f in futures if f.exception() is None]
    assert won == [seen + 1] and all(isinstance(f.exception(), sources.CommitConflict) for f in futures if f.exception())
    assert sources.read_written(spark, where).count() in (10, 11, 12, 13)
    with ThreadPoolExecutor(4) as pool:  # without a base all succeed, one after another
        numbers = sorted(pool.map(lambda n: sources.write_catalog(spark.range(n), where), (20, 21, 22)))
    assert numbers == [seen + 2, seen + 3, seen + 4] and sources.last_version(spark, where) == seen + 4
    assert sources.read_written(spark, where, seen).count() == 1
    assert sources.expire_versions(spark, where, keep=2) == [seen, seen + 1, seen + 2]
    assert sources.read_written(spark, where).count() in (20, 21, 22)
    assert sources.write_catalog(spark.range(5), where) == seen + 5


def test_index_falls_back_to_metadata(spark, tmp_path):
    rows = [{"card_id": "a", "name": "A", "embedding": [1.0, 0.0]}, {"card_id": "b", "name": "B"}]
    (tmp_path / "meta.json").write_text(json.dumps(rows))
    spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "position int, embedding array<float>").write.parquet(str(tmp_path / "two"))
    spark.createDataFrame([(0, [0.0, 1.0])], "position int, embedding array<float>").write.parquet(str(tmp_path / "one"))
    read = lambda v: {r["card_id"]: list(r["embedding"]) for r in sources.read_index(spark, str(tmp_path / "meta.json"), v).collect()}
    assert read(str(tmp_path / "two")) == {"a": [0.0, 1.0], "b": [1.0, 1.0]}
    assert read(str(tmp_path / "one")) == read(None) == {"a": [1.0, 0.0]}


def test_fetching_tries_again_and_asks_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def get(search):
        with open(log, "a") as f:
            f.write(search + "\n")
        with open(log) as f:
            n = f.read().split("\n").count(search)
        if search == "down":
            raise OSError("no answer")
        return None if search == "slow" and n < 3 else [] if search == "none" else [{"id": search, "name": "N", "set": {"id": "s"}}]

    asked = spark.createDataFrame([("ok",), ("ok",), ("slow",), ("down",), ("none",), (None,)], "search string").coalesce(1)
    found = sources.fetch_cards(asked, get, wait=0.0).cache()
    assert sorted((r["search"], r["card"] and r["card"]["id"]) for r in found.collect()) == [("none", None), ("ok", "ok"), ("slow", "slow")]
    calls = open(log).read().split()
    assert (calls.count("ok"), calls.count("slow"), calls.count("down"), calls.count("none")) == (1, 3, 3, 1)
    assert [r["search"] for r in sources.unseen(asked.where("search is not null"), found).collect()] == ["down"]


def test_answers(spark):
    cards = spark.createDataFrame([MEW, MEWTWO], CARDS)
    scans = spark.createDataFrame([(1, "0151/165", "Mewe", 180), (2, None, "Mewtwo", None), (3, None, None, None), (4, "151/165", "Mewtwo", 120), (5, None, "Mew ex", 60)], SCANS)
    seen = spark.createDataFrame([(4, "b-151", 0.93), (2, "a-151", 0.95), (3, "a-151", 0.99), (5, "a-151", 0.9)], "scan_id long, id string, similarity double")
    got = {r["scan_id"]: r for r in scoring.responses(scans, cards, seen).collect()}
    one = got[1]
    assert (one["verified"], one["name"], one["hp"], one["unique_id"], one["market_price"], one["confidence"], one["message"]) == (True, "Mew ex", 180, "0151/165", 4.5, 0.95, None)
    assert [c["unique_id"] for c in one["candidates"]] == ["151/165", "151"]
    assert (got[2]["verified"], got[2]["name"], got[2]["confidence"], got[2]["disagreement"], got[2]["message"]) == (False, None, 0.0, False, "No confident match found.")
    assert (got[5]["verified"], got[5]["disagreement"]) == (False, True)
    assert (got[3]["verified"], got[3]["best_score"], got[3]["message"], got[3]["rarity"]) == (False, 0.0, "No cards found.", "Unknown")
    assert (got[4]["verified"], got[4]["visual_match_applied"], got[4]["name"], got[4]["unique_id"], got[4]["best_score"]) == (True, True, "Mewtwo", "151", 93.0)
    assert (got[4]["visual_similarity"], got[4]["visual_candidate"]) == (0.93, None)
    assert (got[2]["visual_similarity"], tuple(got[2]["visual_candidate"]), got[3]["visual_candidate"]) == (None, ("Mew ex", 180, 0.95), None)
    body = {r["scan_id"]: json.loads(r["body"]) for r in scoring.response_json(scoring.responses(scans, cards, seen)).collect()}
    assert body[3]["name"] is None and body[3]["verified"] is False and body[3]["candidates"] == [] and body[1]["candidates"][0] == {"unique_id": "151/165", "hp": 180, "confidence": 0.95}


def test_abstaining_scan_has_no_match(spark):
    scans = spark.createDataFrame([(1, None, "Mew ex", 180)], SCANS)
    row = scoring.decide(scans, scoring.evidence(scans, spark.createDataFrame([MEW], CARDS))).first()
    assert (row["id"], row["best_id"], row["best_score"], row["verified"], row["confidence"]) == (None, "a-151", 40.0, False, 0.0)


def test_fallback_starts_with_the_local_catalogue(spark):
    cards = spark.createDataFrame([MEW, MEWTWO], CARDS)
    scans = spark.createDataFrame([(1, "151/165", None, None), (2, None, "Mewt", None), (3, "999", "Zzz", None)], SCANS)
    got = {r["scan_id"]: (r["step"], r["kind"], r["key"]) for r in candidates.fallback_chain(scans, cards).collect()}
    assert got[1] == (0, "local", None) and got[2][0] == 0 and 3 not in got


def test_gate_turns_empty_frames_away(spark):
    rows = [(None, None, None, None, None, None), (300.0, None, 0.5, True, 0.0, 0.0), (300.0, 0.0, 0.05, None, None, None)]
    got = quality.gate(spark.createDataFrame(rows, "lap double, glare double, area double, card_like boolean, ml_blurry double, ml_glare double")).collect()
    assert [(r["reason"], r["quality"]) for r in got] == [("empty", 0.0), ("empty", 0.0), ("no card", 0.0)]


def test_boxes(spark):
    rows = [(1, 0, "card", 50, 50, 200, 300, 0.9, 630, 880), (2, 0, "card", 700, 10, 800, 40, 0.9, 630, 880), (3, 0, "other", 1, 1, 9, 9, 0.9, 630, 880), (4, 0, "card", 5, 5, 9, 9, 0.80001, 630, 880), (4, 1, "card", 6, 6, 9, 9, 0.80003, 630, 880), (5, 0, "card", 9, 9, 4, 20, 0.7, 630, 880)]
    got = {r["image"]: r for r in boxes.best_boxes(spark.createDataFrame(rows, "image long, ord long, label string, x1 int, y1 int, x2 int, y2 int, confidence double, image_width int, image_height int")).collect()}
    assert tuple(got[1])[3:] == (150, 250, 50, 50, 200, 300) and tuple(got[2])[3:] == (100, 30, 629, 10, 630, 40)
    assert 3 not in got and got[4]["x1"] == 5 and tuple(got[5])[3:] == (0, 11, None, None, None, None)


def test_image_metrics_by_hand(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), np.full((4, 4, 1), 255, np.uint8), rng.integers(0, 256, (1, 6, 1)).astype(np.uint8)]
    df = spark.createDataFrame([(i, x.tobytes(), *x.shape) for i, x in enumerate(images)] + [(9, b"", 0, 0, 1)], "i int, data binary, h int, w int, c int")
    got = {r["i"]: r["m"] for r in df.select("i", quality.image_metrics("data", "h", "w", "c").alias("m")).collect()}
    for i, x in enumerate(images):
        h, w, c = x.shape
        grey = [[float(x[r, q, 0]) if c == 1 else float(round(0.114 * x[r, q, 0] + 0.587 * x[r, q, 1] + 0.299 * x[r, q, 2])) for q in range(w)] for r in range(h)]
        mirror = lambda k, n: 0 if n == 1 else (-k if k < 0 else 2 * (n - 1) - k if k >= n else k)
        edge = lambda k, n: min(max(k, 0), n - 1)
        at = mirror if min(h, w) > 1 else edge
        lap = [grey[at(r - 1, h)][q] + grey[at(r + 1, h)][q] + grey[r][at(q - 1, w)] + grey[r][at(q + 1, w)] - 4 * grey[r][q] for r in range(h) for q in range(w)]
        mean = sum(lap) / len(lap)
        assert abs(got[i]["laplacian"] - sum((v - mean) ** 2 for v in lap) / len(lap)) < 1e-6
        assert got[i]["glare"] == sum(v > 250 for row in grey for v in row) / (h * w) and got[i]["aspect"] == min(h, w) / max(h, w)
    assert got[9]["laplacian"] is None


def test_vectors_with_nulls_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in vectors.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 1.0)]
    assert vectors.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    lengths = {r[0]: r[1] for r in spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<double>").select("i", vectors.normalised(F.col("v"))).collect()}
    assert lengths == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


def test_request_metrics(spark):
    log = spark.createDataFrame([("GET", "/a", 200, 1.0), ("GET", "/a", 200, 2.0), ("GET", "/a", None, 9.0)], "method string, path string, status int, ms double")
    assert {(r["status"], r["requests"], r["mean_ms"], r["longest_ms"]) for r in scoring.request_metrics(log).collect()} == {(200, 2, 1.5, 2.0), (None, 1, 9.0, 9.0)}
