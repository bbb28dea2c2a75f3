"""Queries of the evidence-matching operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import answers, boxes, candidates, consensus, contenders, quality, scoring, vectors
from ..sources import cards as card_files
from ..sources import uploads
from ..sources.fixtures import view
from .oracles import ORACLES  # noqa: F401 - part of the registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _columns(name: str, source: str, *columns):
    """Registers a query that projects a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(*(c() if callable(c) else c for c in columns))

    QUERIES[name] = run


def _scans_and_cards(spark, sf_dir):
    return view(spark, sf_dir, "scans"), view(spark, sf_dir, "cards")


def _pairs(spark, sf_dir):
    """Distinct spellings of scans with distinct names of the catalogue that share their first two letters."""
    scans, cards = _scans_and_cards(spark, sf_dir)
    a = scans.where("ocr_name is not null").select(F.lower("ocr_name").alias("a")).distinct()
    b = cards.select(F.lower("name").alias("b")).distinct()
    return a.join(b, F.substring("a", 1, 2) == F.substring("b", 1, 2)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


@_query
def q01_catalog_compact(spark, sf_dir):
    """Every fourth card has no set of its own, and every fourth one with its own name."""
    cards = view(spark, sf_dir, "cards")
    sets = cards.groupBy(F.col("set_id").alias("id")).agg(F.min("set_name").alias("name"), F.min("set_series").alias("series"), F.max("printed_total").alias("printed_total"))
    own = lambda c: F.when(F.col("k") % 4 != 0, F.col(c)).alias(c)
    name = F.when(F.col("k") % 4 == 1, F.concat(F.lit("own "), "set_name")).when(F.col("k") % 4 != 0, F.col("set_name"))
    return candidates.compact(cards.select("id", "name", "hp", "number", "rarity", F.col("set_id").alias("stem"), own("set_id"), name.alias("set_name"), own("set_series"), own("printed_total")), sets)


_columns("q02_number_keys", "cards", "id", lambda: F.array_join(text.number_keys(F.col("number")), ",").alias("keys"), lambda: F.array_join(text.alias_keys(F.col("set_id"), F.col("number")), ",").alias("aliases"))


@_query
def q03_number_candidates(spark, sf_dir):
    return candidates.by_number(*_scans_and_cards(spark, sf_dir))


_columns("q04_root_name", "cards", "id", lambda: text.catalog_root(F.col("name")).alias("catalog_root"), lambda: text.closed_root(F.col("name")).alias("closed_root"))
_columns("q05_clean_key", "scans", "scan_id", lambda: text.clean_key(F.col("ocr_name")).alias("key"))


@_query
def q06_exact_name(spark, sf_dir):
    scans, cards = _scans_and_cards(spark, sf_dir)
    asked = scans.where("ocr_name is not null")
    found = candidates.exact_names(asked.select("ocr_name").distinct(), candidates.closed_names(cards))
    return asked.select("scan_id", "ocr_name").join(found, "ocr_name", "left").select("scan_id", "match")


@_query
def q07_fuzzy_top8(spark, sf_dir):
    return candidates.fuzzy_names(*_scans_and_cards(spark, sf_dir)).select("root", "known", "score", "place")


@_query
def q08_prefix_block(spark, sf_dir):
    scans, cards = _scans_and_cards(spark, sf_dir)
    return candidates.name_pool(scans.where("ocr_name is not null").select("ocr_name").distinct(), candidates.closed_names(cards))


@_query
def q09_indel_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("ratio"))


@_query
def q10_token_set_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", similarity.token_set_ratio(F.col("a"), F.col("b")).alias("ratio"))


@_query
def q11_partial_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", similarity.partial_ratio(F.col("a"), F.col("b")).alias("ratio"))


@_query
def q12_closed_set_match(spark, sf_dir):
    scans, cards = _scans_and_cards(spark, sf_dir)
    return candidates.closed_set(scans.where("ocr_name is not null").select("ocr_name").distinct(), candidates.closed_names(cards))


@_query
def q13_resolve_candidates(spark, sf_dir):
    """Of all frames' names of a burst, the surest match; of equals the first."""
    reads, cards = view(spark, sf_dir, "readings"), view(spark, sf_dir, "cards")
    matched = candidates.closed_set(reads.select(F.col("name").alias("ocr_name")).distinct(), candidates.closed_names(cards))
    joined = reads.join(matched, reads.name == matched.ocr_name).where("match is not null")
    best = joined.groupBy("burst_id").agg(F.max_by(F.struct("match", "confidence"), F.struct("confidence", -F.col("frame_no"))).alias("b"))
    return best.select("burst_id", "b.match", "b.confidence")


_columns("q14_parse_printed_id", "id_texts", "event_id", lambda: text.printed_id(F.col("txt"))["id"].alias("id"), lambda: text.printed_id(F.col("txt"))["confidence"].alias("confidence"), lambda: text.printed_id(F.col("txt"))["pattern"].alias("pattern"))
_columns("q15_parse_hp", "id_texts", "event_id", lambda: text.hp(F.col("txt")).alias("hp"))


def _with_totals(spark, sf_dir, source):
    """A view beside the catalogue's set totals, a row with one array."""
    totals = view(spark, sf_dir, "cards").agg(F.collect_set(F.col("printed_total").cast("string")).alias("totals"))  # as many as there are totals of sets
    return view(spark, sf_dir, source).join(F.broadcast(totals))


@_query
def q16_parse_collector_id(spark, sf_dir):
    return _with_totals(spark, sf_dir, "id_texts").select("event_id", text.collector_id(F.col("txt"), F.col("totals")).alias("id"))


@_query
def q17_correct_set_total(spark, sf_dir):
    total = F.lpad(((F.col("session") * 7 + F.col("seq")) % 300).cast("string"), 3, "0")
    return _with_totals(spark, sf_dir, "votes").select("session", "seq", text.set_total(total, F.col("totals")).alias("total"))


_columns("q18_fix_slash", "id_texts", "event_id", lambda: text.with_slash(F.col("txt")).alias("fixed"))
_columns("q19_restricted_alphabet", "id_texts", "event_id", lambda: text.restricted(F.col("txt"), "hp").alias("hp"), lambda: text.restricted(F.col("txt"), "collector_id").alias("collector_id"))
_columns("q20_token_normalize", "scans", "scan_id", lambda: text.name_token(F.concat("ocr_name", F.lit("@x!"))).alias("token"), lambda: text.names_something(text.name_token(F.col("ocr_name"))).alias("plausible"))


@_query
def q21_font_size_name(spark, sf_dir):
    """Names from the tokens of each scan, laid out by position and case."""
    scans = view(spark, sf_dir, "scans").where("ocr_name is not null")
    tokens = scans.select("scan_id", F.posexplode(F.split("ocr_name", " ")).alias("ord", "text"))
    x1 = F.col("ord") * 60.0 + (F.col("scan_id") % 7)
    return boxes.name_by_size(tokens.select("scan_id", "ord", "text", x1.alias("x1"), (x1 + 50).alias("x2"), F.lit(10.0).alias("y1"), (40.0 - F.col("ord") * 5).alias("y2")))


@_query
def q22_roi_vote(spark, sf_dir):
    reads = view(spark, sf_dir, "readings").select("burst_id", F.col("frame_no").alias("ord"), "printed_id", "roi", F.lit(0.95).alias("confidence"), F.when(F.col("printed_id").startswith("SVP"), "promo_prefix").otherwise("standard_fraction").alias("pattern"))
    return consensus.region_vote(reads, "burst_id")


@_query
def q23_modal_value(spark, sf_dir):
    return consensus.modal(view(spark, sf_dir, "readings"), "burst_id", "printed_id", "frame_no")


@_query
def q24_fuzzy_consensus(spark, sf_dir):
    """With Ratcliff-Obershelp similarity, which SQL can't express."""
    return consensus.name_consensus(view(spark, sf_dir, "readings"), "burst_id", "name", "frame_no", similarity.matching_blocks)


@_query
def q25_quality_gate(spark, sf_dir):
    return quality.gate(view(spark, sf_dir, "frames")).select("burst_id", "frame_no", "reason")


@_query
def q26_quality_score(spark, sf_dir):
    return quality.gate(view(spark, sf_dir, "frames")).where("reason is null").select("burst_id", "frame_no", "quality")


@_query
def q27_burst_consensus(spark, sf_dir):
    return consensus.burst_consensus(quality.gate(view(spark, sf_dir, "readings")))


@_query
def q28_capture_confidence(spark, sf_dir):
    burst = consensus.burst_consensus(quality.gate(view(spark, sf_dir, "readings")))
    db = F.when(F.col("hp").isNull(), 0.0).otherwise(F.col("hp") / 400.0)
    return burst.select("burst_id", consensus.capture_confidence(F.col("n_passed"), F.col("n_frames"), F.col("id_agreement"), F.col("name_agreement"), F.col("hp_agreement"), db).alias("confidence"))


@_query
def q29_evidence_scores(spark, sf_dir):
    return scoring.evidence(*_scans_and_cards(spark, sf_dir)).select("scan_id", "id", "total_score", "num_score", "name_score", "hp_score", "final_score", "n_evidence", "strong", "set_identity")


@_query
def q30_verify_decision(spark, sf_dir):
    scans, cards = _scans_and_cards(spark, sf_dir)
    return scoring.decide(scans, contenders.best_evidence(scans, cards, 1))


@_query
def q31_top5_candidates(spark, sf_dir):
    return scoring.summaries(contenders.best_evidence(*_scans_and_cards(spark, sf_dir)))


@_query
def q32_vector_topk(spark, sf_dir):
    return vectors.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def _seen(scans, cards):
    """A visual candidate for each scan: its own card or one of the next three."""
    n = cards.agg(F.count("*")).scalar()
    of = scans.select("scan_id", ((F.col("scan_id") * 7 + F.col("scan_id") % 4) % n).alias("k"), ((F.col("scan_id") % 25 + 75) / 100).alias("similarity"))
    return of.join(cards.select("k", "id"), "k").select("scan_id", "id", "similarity")


@_query
def q33_visual_gate(spark, sf_dir):
    scans, cards = _scans_and_cards(spark, sf_dir)
    return scoring.visual_gate(scans, _seen(scans, cards), cards, candidates.with_any(scans, cards))


@_query
def q34_rejection_mode(spark, sf_dir):
    return consensus.rejection_mode(quality.gate(view(spark, sf_dir, "frames")))


@_query
def q35_multi_frame_vote(spark, sf_dir):
    return consensus.history_vote(view(spark, sf_dir, "votes"))


_columns("q36_price_chain", "cards", "id", lambda: scoring.market_price(F.col("holofoil"), F.col("normal"), F.col("reverse_holofoil"), F.col("first_edition")).alias("price"))


@_query
def q37_id_format(spark, sf_dir):
    """The printed id of each scan's best candidate."""
    scans, cards = _scans_and_cards(spark, sf_dir)
    best = scoring.ranked(contenders.best_evidence(scans, cards, 1), 1)
    return best.join(scans.select("scan_id", "collector_id"), "scan_id").select("scan_id", scoring.verified_id(F.col("collector_id"), F.col("number"), F.col("printed_total")).alias("unique_id"))


@_query
def q38_known_totals(spark, sf_dir):
    built_in = spark.createDataFrame([(t,) for t in text.KNOWN_TOTALS], "total string")
    return view(spark, sf_dir, "cards").select(F.col("printed_total").cast("string").alias("total")).unionByName(built_in).distinct()


@_query
def q39_fallback_chain(spark, sf_dir):
    return candidates.fallback_chain(*_scans_and_cards(spark, sf_dir))


@_query
def q40_bbox_best_per_class(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = lines.select(
        F.col("l_orderkey").alias("image"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_returnflag") == "A", "card").when(F.col("l_returnflag") == "N", "header_region").otherwise("stray").alias("label"),
        (F.col("l_suppkey") * 3 - 20).cast("int").alias("x1"), (F.col("l_linenumber") * 30 - 40).cast("int").alias("y1"), (F.col("l_suppkey") * 9 + 40).cast("int").alias("x2"), (F.col("l_linenumber") * 150).cast("int").alias("y2"),
        (F.col("l_quantity") / 50).alias("confidence"), F.lit(630).alias("image_width"), F.lit(880).alias("image_height"),
    )
    return boxes.best_boxes(found)


@_query
def q43_crop_regions(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 17 + 100).alias("h"), (F.col("p_size") * 11 + 90).alias("w"))
    return sizes.select("p_partkey", F.explode(boxes.regions(F.col("h"), F.col("w"))).alias("r")).select("p_partkey", "r.*")


@_query
def q41_image_metrics(spark, sf_dir):
    """Measurements of small images made from embeddings: rows of 8 grey pixels."""
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex((F.greatest(F.least(x * 400 + 128, F.lit(255.0)), F.lit(0.0))).cast("int")), 2, "0"))
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.unhex(F.array_join(pixel, "")).alias("data"), (F.size("embedding") / 8).cast("int").alias("h"))
    return images.select("vec_id", quality.image_metrics("data", "h", F.lit(8), F.lit(1)).alias("m")).select("vec_id", "m.*")


@_query
def q42_file_listing(spark, sf_dir):
    """Names and sizes of the tables' files."""
    return card_files.listing(spark, sf_dir, ("parquet",)).select("name", "size_bytes")


@_query
def q44_responses(spark, sf_dir):
    """The scan service's answers, the list of candidates as its length and its first entry."""
    scans, cards = _scans_and_cards(spark, sf_dir)
    answers = scoring.responses(scans, cards, _seen(scans, cards))
    first = F.get("candidates", 0)
    beside = [F.col(f"visual_candidate.{f}").alias(f"seen_{f}") for f in ("name", "hp", "similarity")]
    return answers.select(*(c for c in answers.columns if c not in ("candidates", "visual_candidate")), *beside, F.size("candidates").alias("n_candidates"), first["unique_id"].alias("first_id"), first["confidence"].alias("first_confidence"))


@_query
def q45_request_metrics(spark, sf_dir):
    """A request log made of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(F.lit("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.when(F.col("event_id") % 10 != 0, F.when(F.col("event_id") % 7 == 0, 413).otherwise(200)).alias("status"), (F.col("event_id") % 1000 * 8).cast("double").alias("ms"))
    return scoring.request_metrics(log)


@_query
def q46_normalised_vectors(spark, sf_dir):
    """Sums of the components of vectors scaled by their id and normalised again; every ninth is zero."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 9))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.normalised(scaled).alias("v"))
    total = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x)), 6)
    return v.select("vec_id", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("squares"))


@_query
def q47_search_results(spark, sf_dir):
    """How many cards each search of the fallback chain finds."""
    scans, cards = _scans_and_cards(spark, sf_dir)
    searches = candidates.fallback_chain(scans, cards.where("k % 3 = 0")).where("step > 0")
    return candidates.search_results(searches, cards).groupBy("kind", "key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))


@_query
def q48_corners(spark, sf_dir):
    """Corners of four points made of each vector's first eight numbers."""
    at = lambda i: F.get("embedding", i).cast("double")
    points = F.array(*[F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(4)])
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", boxes.corners(points).alias("c"))
    return found.select("vec_id", *(F.col(f"c.{c}.{a}").alias(f"{c}_{a}") for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("x", "y")))


@_query
def q49_reading_order(spark, sf_dir):
    """The lines of each order as boxes, from left to right, and the box around them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = F.struct((F.col("l_partkey") % 50).alias("x1"), F.col("l_linenumber").alias("y1"), (F.col("l_partkey") % 50 + 10).alias("x2"), (F.col("l_linenumber") + 3).alias("y2"), F.col("l_suppkey").alias("name"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", box.alias("b"))
    grouped = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["b"]).alias("bs"))
    placed = grouped.select("l_orderkey", F.array_join(F.transform(boxes.left_to_right(F.col("bs")), lambda b: b["name"].cast("string")), ",").alias("names"), boxes.line_box(F.col("bs")).alias("a"))
    return placed.select("l_orderkey", "names", "a.x1", "a.y1", "a.x2", "a.y2")


@_query
def q50_burst_answers(spark, sf_dir):
    """The answers to all bursts, the list of candidates as its length."""
    found = answers.burst_answers(quality.gate(view(spark, sf_dir, "readings")), view(spark, sf_dir, "cards"))
    columns = ["burst_id", "success", "verified", "confidence", "capture_confidence", "total_frames", "passed_frames", "rejection_reason", "name", "hp", "unique_id", "set_name", "rarity", "best_score", "name_agreement", "hp_agreement", "id_agreement", "message"]
    return found.select(*columns, F.size("candidates").alias("n_candidates"))


@_query
def q51_evidence_by_scan(spark, sf_dir):
    """All rows of q29 folded by scan: counts and sums of their scores, in millionths."""
    scans, cards = _scans_and_cards(spark, sf_dir)
    scored = scoring.evidence(scans, cards)
    total = lambda c: F.sum(F.floor(F.col(c) * 1_000_000 + 0.5)).alias(c)
    flag = lambda c: F.count_if(F.col(c)).alias(c)
    # numbers only, which are added up where the pairs are made; the ids follow from the keys
    sums = scored.groupBy("scan_id").agg(F.count("*").alias("n"), *map(total, ("total_score", "num_score", "name_score", "hp_score", "final_score")), F.sum("n_evidence").alias("n_evidence"), flag("strong"), flag("set_identity"))
    return sums.join(scoring.least_and_greatest(scans, cards), "scan_id").select("scan_id", "n", "least", "greatest", *sums.columns[2:])


@_query
def q52_upload_refusals(spark, sf_dir):
    """Multipart bodies made of pages, split into their parts and judged: some aren't images, some don't look like one, some are too large."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 7 == 0, "text/html").otherwise("image/png")
    head = F.format_string('--cut\r\nContent-Disposition: form-data; name="file"; filename="%d.png"\r\nContent-Type: %s\r\n\r\n', "page_id", kind)
    content = F.concat(F.when(F.col("page_id") % 5 != 0, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("00"))), F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    body = F.concat(F.encode(head, "utf-8"), content, F.encode(F.lit("\r\n--cut--\r\n"), "utf-8"))
    requests = pages.select(F.col("page_id").alias("request_id"), F.lit("multipart/form-data; boundary=cut").alias("content_type"), body.alias("body"))
    return uploads.judge_scans(uploads.read_parts(requests), most_bytes=4000)
