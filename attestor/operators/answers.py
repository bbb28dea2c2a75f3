"""Answers to bursts of frames: consensus, then verification, then one response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consensus import burst_consensus, capture_confidence, rejection_mode
from .scoring import responses, rounded


def burst_answers(frames: DataFrame, cards: DataFrame) -> DataFrame:
    """One response for each burst.

    ``frames`` has passed the gate's marking (``reason``, ``quality``) and has burst_id, frame_no, name, hp
    and printed_id. What the frames that pass agree on is verified like a scan, once for each distinct
    name, hp and id; what isn't verified keeps the consensus. A burst of which no frame passes has no
    success, and the most frequent reason as its message.
    """
    burst = burst_consensus(frames)
    key = F.to_json(F.struct("printed_id", "name", "hp"), {"ignoreNullFields": "false"}).alias("scan_id")
    asked = burst.select("*", key)
    scans = asked.select("scan_id", F.col("printed_id").alias("collector_id"), F.col("name").alias("ocr_name"), F.col("hp").alias("ocr_hp")).distinct()
    found = responses(scans, cards)
    fields = [c for c in found.columns if c not in ("scan_id", "name", "hp", "unique_id", "visual_match_applied", "visual_similarity", "visual_candidate", "disagreement")]
    joined = asked.alias("b").join(found.alias("r"), "scan_id")
    agree = {c: F.col(f"b.{c}") for c in ("name_agreement", "hp_agreement", "id_agreement")}
    passed = joined.select(
        "burst_id", F.lit(True).alias("success"), *fields,
        capture_confidence(F.col("n_passed"), F.col("n_frames"), agree["id_agreement"], agree["name_agreement"], agree["hp_agreement"], F.col("r.confidence")).alias("capture_confidence"),
        F.col("n_frames").alias("total_frames"), F.col("n_passed").alias("passed_frames"), F.lit(None).cast("string").alias("rejection_reason"),
        F.coalesce("r.name", "b.name").alias("name"), F.coalesce("r.hp", "b.hp").alias("hp"), F.coalesce("r.unique_id", "b.printed_id").alias("unique_id"),
        *(rounded(x, 2).alias(c) for c, x in agree.items()),
    )
    counts = frames.groupBy("burst_id").agg(F.count("*").alias("total_frames"))
    lost = rejection_mode(frames).join(counts, "burst_id").select("burst_id", F.lit(False).alias("success"), "total_frames", F.lit(0).cast("long").alias("passed_frames"), F.col("reason").alias("rejection_reason"), F.col("reason").alias("message"), F.lit("Unknown").alias("rarity"))
    zeros = [c for c in ("confidence", "capture_confidence", "best_score", "name_agreement", "hp_agreement", "id_agreement")]
    lost = lost.withColumns({c: F.lit(0.0) for c in zeros} | {"verified": F.lit(False), "candidates": F.array().cast(found.schema["candidates"].dataType)})
    return passed.unionByName(lost, allowMissingColumns=True)
