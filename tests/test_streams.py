"""Voter and bursts as streams: equal to the batch operators, with state that is forgotten."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from attestor.operators import consensus
from attestor.streaming import bursts
from attestor.streaming.voter import stream_votes

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FRAMES = "camera long, ts timestamp, frame_no long, reason string, quality double, name string, hp int, printed_id string"
VOTES = "session long, ts timestamp, seq long, printed_id string, confidence double, frame_quality double"


def batches(spark, tmp_path, rows, schema):
    """A stream that takes each list of rows as one micro-batch."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))


def run(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    states = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    query.stop()
    return df.sparkSession.table(name).collect(), states


def test_silent_sessions_are_forgotten(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    vote = lambda session, s, n: (session, at(s), n, "XY1", 0.8, 80.0)
    parts = [[vote(1, 0, 1), vote(1, 1, 2), vote(2, 1, 1)], [vote(2, 30, 2)], [vote(2, 100, 3)], [vote(1, 101, 3), vote(2, 102, 4)], [vote(3, 300, 1)], [vote(3, 301, 2)]]
    stream = batches(spark, tmp_path, parts, VOTES).withWatermark("ts", "1 second")
    rows, states = run(stream_votes(stream, expire="60 seconds", time_col="ts"), tmp_path, "votes_expiring")
    got = {(r["session"], r["seq"]): r["status"] for r in rows}
    # session 1 was silent for 100 s and starts anew, session 2 for 70 s
    assert got[1, 2] == "ambiguous" and got[1, 3] == "rejected"
    assert got[2, 2] == "ambiguous" and got[2, 3] == "rejected" and got[2, 4] == "ambiguous" and got[3, 2] == "ambiguous"
    assert states[-1] < max(states) + 3


def expected_bursts(rows, gap, most):
    """Bursts of frames in the order of time, cut at gaps and at ``most`` frames."""
    out, now = [], 0
    for camera in sorted({r[0] for r in rows}):
        last, n = None, 0
        for r in sorted((r for r in rows if r[0] == camera), key=lambda r: (r[1], r[2])):
            if last is None or (r[1] - last).total_seconds() > gap or n == most:
                now, n = now + 1, 0
            out.append((now, r))
            last, n = r[1], n + 1
    return out


def test_closed_bursts_have_the_batch_consensus(spark, tmp_path):
    rng = random.Random(11)
    names = ["Mew ex", "Mewe", "Mew", "Charizard VMAX", "Charizrd", None, "12"]
    rows, n = [], 0
    for camera in (1, 2):
        t = START
        for _ in range(9):
            t += timedelta(seconds=20)
            for _ in range(rng.choice([1, 3, 8, 27])):
                n += 1
                t += timedelta(milliseconds=rng.randint(1, 900))
                rows.append((camera, t, n, rng.choice([None, None, None, "glare"]), float(rng.randint(1, 5)), rng.choice(names), rng.choice([None, 60, 120]), rng.choice([None, "1/2", "XY1"])))
    marked = expected_bursts(rows, 5, 20)
    frames = spark.createDataFrame([(b, *r) for b, r in marked], f"burst_id long, {FRAMES}")
    columns = ["n_frames", "n_passed", "best_frame", "name", "hp", "printed_id", "name_agreement", "hp_agreement", "id_agreement"]
    key = lambda r: tuple(str(r[c]) for c in columns)
    want = sorted(map(key, consensus.burst_consensus(frames).collect()))
    # out of order by a few seconds, and with a last frame that moves the watermark on
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 4)))
    end = max(r[1] for r in rows)
    parts = [late[k : k + 40] for k in range(0, len(late), 40)] + [[(9, end + timedelta(seconds=60), 1, None, 1.0, None, None, None)], [(9, end + timedelta(seconds=61), 2, None, 1.0, None, None, None)]]
    rows, states = run(bursts.stream_bursts(batches(spark, tmp_path, parts, FRAMES)), tmp_path, "bursts_closed")
    assert sorted(map(key, rows)) == want
    assert len({(r["camera"], r["burst_start"]) for r in rows}) == len(rows)
    assert states[-1] < max(states)


def test_late_frames_are_dropped(spark, tmp_path):
    frame = lambda s, n: (1, START + timedelta(seconds=s), n, None, 1.0, "Mew", 60, "1/2")
    parts = [[frame(0, 1), frame(1, 2)], [frame(100, 3)], [frame(2, 4), frame(101, 5)], [frame(300, 6)], [frame(301, 7)]]
    rows, _ = run(bursts.stream_bursts(batches(spark, tmp_path, parts, FRAMES)), tmp_path, "bursts_late")
    assert sorted((r["n_frames"], r["best_frame"]) for r in rows) == [(2, 1), (2, 3)]


def test_names_are_alike_as_in_columns(spark):
    from attestor.functions import similarity

    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcx") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcx") for _ in range(rng.randint(0, 70)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (similarity.ratio(F.col("a"), F.col("b")) / 100.0).alias("s")).collect()
    assert all(r["s"] == bursts.alike(r["a"], r["b"]) for r in rows)
