"""Consensus over the frames of a burst, and over the regions of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

#: Similarity from which two names agree.
AGREE = 0.78
#: Distinct names up to which a group's are compared in one row.
FEW = 64


def modal(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Rows (group, mode, n): the most frequent value that isn't null; of equals the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(group).agg(F.max_by(F.struct(F.col(value).alias("v"), "n"), F.struct("n", (-F.col("first")).alias("first"))).alias("b"))
    return best.select(group, F.col("b.v").alias("mode"), F.col("b.n").alias("n"))


def region_weight(pattern: Column, printed_id: Column, roi: Column) -> Column:
    """What the region that an id was read in adds to its confidence."""
    left, right = roi.contains("left"), roi.contains("right")
    tight = F.when(roi.contains("surgical"), 0.10).otherwise(0.0)
    fraction = F.when(left, 0.15).when(right, -0.10).otherwise(0.0)
    promo = F.when(printed_id.startswith("SVP"), F.when(left, 0.15).otherwise(0.0)).otherwise(F.when(right, 0.15).otherwise(0.0))
    return tight + F.when(pattern.isin("standard_fraction", "subset_fraction", "of_fraction"), fraction).when(pattern == "promo_prefix", promo).otherwise(0.0)


def region_vote(reads: DataFrame, group: str) -> DataFrame:
    """Rows (group, printed_id, score, roi): the id with the largest sum of weighted confidences, of equals the one read first.

    ``reads`` has group, ord, printed_id, confidence, pattern and roi.
    """
    weighted = reads.where("printed_id is not null").withColumn("w", F.col("confidence") + region_weight(F.col("pattern"), F.col("printed_id"), F.col("roi")))
    sums = weighted.groupBy(group, "printed_id").agg(F.round(F.sum("w"), 6).alias("score"), F.min_by("roi", "ord").alias("roi"), F.min("ord").alias("first"))
    best = Window.partitionBy(group).orderBy(F.desc("score"), "first")
    return sums.withColumn("n", F.row_number().over(best)).where("n = 1").select(group, "printed_id", "score", "roi")


def name_consensus(rows: DataFrame, group: str, value: str, order: str, similar=None) -> DataFrame:
    """Rows (group, name, agreement): the name most like all names of its group, and the share of names that agree with it.

    Each name is compared with the distinct names of its group, weighted by how often they occur; equal
    means go to a name with a suffix, then to the first. ``similar`` makes the similarity of two
    columns, by default the indel ratio from 0 to 1. With that or ``matching_blocks``, groups of up to FEW
    names are judged whole, so that no pairs are exchanged.
    """
    known = {None: "ratio", similarity.matching_blocks: "matching_blocks"}.get(similar)
    similar = similar or (lambda a, b: similarity.ratio(a, b) / 100.0)
    bare = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    # dealt by group, so that names and groups are counted without another exchange
    seen = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("name"), F.col(order).alias("_order")).repartition(group)
    names = seen.groupBy(group, "name").agg(F.count("*").alias("n"), F.min("_order").alias("first")).withColumn("bare", bare)
    if known is None:
        return _consensus_by_pairs(names, group, similar)
    entry = F.struct("name", "n", "first", "bare")
    groups = names.groupBy(group).agg(F.count("*").alias("size"), F.collect_list(entry).alias("names"))
    few = groups.where(F.col("size") <= FEW).select(group, "names", similarity.EACH_WITH_EACH[known](F.col("names")["bare"]).alias("alike"))
    return _consensus_of_few(few, group).unionByName(_consensus_by_pairs(groups.where(F.col("size") > FEW).select(group, F.explode("names").alias("e")).select(group, "e.*"), group, similar))


def _has_suffix(name: Column) -> Column:
    return name.rlike(r"(?i)\s(?:ex|gx|v|vmax|vstar)$")


def _consensus_of_few(groups: DataFrame, group: str) -> DataFrame:
    """For groups as arrays of names and of the similarities of each with each."""
    names, size = F.col("names"), F.size("names")
    total = F.aggregate("names", F.lit(0).cast("long"), lambda t, e: t + e["n"])
    each = F.sequence(F.lit(0), size - 1)
    mean = lambda i: F.aggregate(each, F.lit(0.0), lambda t, j: t + F.get("alike", i * size + j) * F.get(names, j)["n"])
    agree = lambda i: F.aggregate(each, F.lit(0).cast("long"), lambda t, j: t + F.when(F.get("alike", i * size + j) >= AGREE, F.get(names, j)["n"]).otherwise(0))
    judged = lambda e, i: F.struct(F.round(mean(i) / F.col("all"), 9).alias("mean"), _has_suffix(e["name"]).alias("suffix"), (-e["first"]).alias("first"), e["name"].alias("name"), F.round(agree(i) / F.col("all"), 9).alias("agreement"))
    best = groups.withColumn("all", total).select(group, "all", F.array_max(F.transform("names", judged)).alias("b"))
    return best.select(group, F.col("b.name").alias("name"), F.when(F.col("all") == 1, 1.0).otherwise(F.col("b.agreement")).alias("agreement"))


def _consensus_by_pairs(names: DataFrame, group: str, similar) -> DataFrame:
    """For rows (group, name, n, first, bare)."""
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, group).select(F.col(group), F.col("a.name"), F.col("a.first"), F.col("b.n").alias("n"), F.col("a.bare").alias("x"), F.col("b.bare").alias("y"))
    distinct = pairs.select("x", "y").distinct()
    alike = distinct.withColumn("s", F.when((F.col("x") == F.col("y")) & (F.col("x") != ""), 1.0).otherwise(similar(F.col("x"), F.col("y"))))
    means = pairs.join(alike, ["x", "y"]).groupBy(group, "name", "first").agg(
        F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 9).alias("mean"), F.round(F.sum(F.when(F.col("s") >= AGREE, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("agreement"), F.sum("n").alias("all")
    )
    best = Window.partitionBy(group).orderBy(F.desc("mean"), F.desc(_has_suffix(F.col("name")).cast("int")), "first")
    chosen = means.withColumn("k", F.row_number().over(best)).where("k = 1")
    return chosen.select(group, "name", F.when(F.col("all") == 1, 1.0).otherwise(F.col("agreement")).alias("agreement"))


def rejection_mode(frames: DataFrame) -> DataFrame:
    """Rows (burst_id, reason, n) of bursts of which no frame passes: the most frequent reason; of equals the first frame's."""
    none = frames.groupBy("burst_id").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("passed")).where("passed = 0").select("burst_id")
    return modal(frames.join(none, "burst_id", "left_semi"), "burst_id", "reason", "frame_no").select("burst_id", F.col("mode").alias("reason"), "n")


def burst_consensus(frames: DataFrame) -> DataFrame:
    """One row for each burst with a frame that passes: consensus values, agreements and the best frame.

    ``frames`` has passed the gate's marking (``reason``, ``quality``) and has name, hp and printed_id.
    """
    passed = frames.where("reason is null")
    base = frames.groupBy("burst_id").agg(F.count("*").alias("n_frames"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_passed")).where("n_passed > 0")
    best = passed.groupBy("burst_id").agg(F.max_by("frame_no", F.struct("quality", -F.col("frame_no"))).alias("best_frame"), F.count("name").alias("n_names"))
    name = name_consensus(passed, "burst_id", "name", "frame_no")
    hp = modal(passed, "burst_id", "hp", "frame_no").select("burst_id", F.col("mode").alias("hp"), F.col("n").alias("hp_n"))
    ids = modal(passed, "burst_id", "printed_id", "frame_no").select("burst_id", F.col("mode").alias("printed_id"), F.col("n").alias("id_n"))
    share = lambda n: F.round(F.coalesce(n, F.lit(0)) / F.col("n_passed"), 9)
    joined = base.join(best, "burst_id").join(name, "burst_id", "left").join(hp, "burst_id", "left").join(ids, "burst_id", "left")
    return joined.select(
        "burst_id", "n_frames", "n_passed", "best_frame", "name", "hp", "printed_id",
        F.round(F.coalesce("agreement", F.lit(0.0)) * F.col("n_names") / F.col("n_passed"), 6).alias("name_agreement"),
        share(F.col("hp_n")).alias("hp_agreement"), share(F.col("id_n")).alias("id_agreement"),
    )


def capture_confidence(passed: Column, total: Column, id_agree: Column, name_agree: Column, hp_agree: Column, db: Column) -> Column:
    """Confidence of a burst from 0 to 100, of two digits; ``db`` is the catalogue's confidence, as a share or in percent."""
    share = F.when(db > 1, db / 100).otherwise(db)
    return F.floor(100 * (0.15 * passed / total + 0.30 * id_agree + 0.15 * name_agree + 0.10 * hp_agree + 0.30 * share) * 100 + 0.5) / F.lit(100.0)


def history_vote(votes: DataFrame, least: int = 3, most: int = 10, quality: float = 50.0) -> DataFrame:
    """Rows (session, seq, printed_id, confidence, status) after each admitted vote.

    Votes with an id and enough frame quality enter a history of the last ``most``. The most frequent
    id (of equals the first there) is accepted from ``least`` votes on with their mean confidence;
    exactly two are ambiguous, with the id and 0.50; else it is rejected, without an id.
    """
    admitted = votes.where(F.col("printed_id").isNotNull() & (F.col("frame_quality") >= quality))
    last = Window.partitionBy("session").orderBy("seq").rowsBetween(-(most - 1), 0)
    held = admitted.select("session", "seq", F.collect_list(F.struct("printed_id", "confidence")).over(last).alias("h"))
    ids = F.transform("h", lambda x: x["printed_id"])
    counted = F.transform(F.array_distinct(ids), lambda i: F.struct(F.size(F.filter("h", lambda x: x["printed_id"] == i)).alias("n"), (-F.array_position(ids, i)).alias("first"), i.alias("id")))
    best = held.withColumn("best", F.array_max(counted))
    of_best = F.filter("h", lambda x: x["printed_id"] == F.col("best.id"))
    mean = F.aggregate(of_best, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.col("best.n")
    n = F.col("best.n")
    return best.select(
        "session", "seq",
        F.when((n >= least) | (n == 2), F.col("best.id")).alias("printed_id"),
        F.when(n >= least, F.round(mean, 6)).when(n == 2, 0.5).otherwise(0.0).alias("confidence"),
        F.when(n >= least, "accepted").when(n == 2, "ambiguous").otherwise("rejected").alias("status"),
    )
