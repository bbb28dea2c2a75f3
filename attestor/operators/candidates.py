"""Candidate generation: which catalogue cards each scan is held against.

The catalogue's keys are exploded once and joined by equality. Names that no key finds are compared
once for each distinct spelling, and only with names that share enough characters to reach the
similarity bound.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text

#: Least similarity and most names of the fuzzy search.
LEAST, MOST = 65, 8
#: Pairs of a key that one task makes at most, unless fewer than SCANS scans have that many.
PAIRS, SCANS = 4_000_000, 1000


def _parts(df: DataFrame) -> int:
    """Partitions for pairs of names: few rows with much work each, which adaptive execution would put into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@cache
def _ratio(a: str, b: str):
    return similarity.ratio(F.col(a), F.col(b))


def compact(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """The catalogue's columns, ordered by id.

    A card keeps its own set (set_id, set_name, set_series, printed_total) whole; only one without a set
    gets that of its file (``stem``) from ``sets`` (id, name, series, printed_total).
    """
    own = F.struct("set_id", "set_name", "set_series", "printed_total")
    found = sets.select(F.col("id").alias("stem"), F.struct(F.col("id").alias("set_id"), F.col("name").alias("set_name"), F.col("series").alias("set_series"), "printed_total").alias("listed"))
    attached = cards.withColumn("own", F.when(F.coalesce("set_id", "set_name", "set_series", F.col("printed_total").cast("string")).isNotNull(), own))
    return attached.join(found, "stem", "left").select("id", "name", "hp", "number", "rarity", F.coalesce("own", "listed").alias("s")).select("id", "name", "hp", "number", "rarity", "s.*").orderBy("id")


def number_query(collector_id):
    """The number asked for: what stands before the first slash, without leading zeros."""
    raw = F.trim(F.substring_index(collector_id, "/", 1))
    return F.when(F.coalesce(collector_id, F.lit("")) == "", None).otherwise(text.no_zeros(raw))


def total_query(collector_id):
    """The total asked for, if there is a slash and something behind it."""
    total = F.trim(F.substring(collector_id, F.call_function("locate", F.lit("/"), collector_id) + 1, F.length(collector_id)))
    return F.when(collector_id.contains("/") & (total != ""), total)


def _all_keys(rows: DataFrame, by: str, key) -> DataFrame:
    """Rows (by, key, keys), once each: the keys of an id, beside all of them in order where there are several."""
    of = rows.select(by, key.alias("key")).where("key is not null").groupBy(by).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return of.select(by, F.explode("keys").alias("key"), F.when(F.size("keys") > 1, F.col("keys")).alias("keys"))


def dealt(scans: DataFrame, cards: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Scans and cards that meet by a key, each with a ``piece`` to meet by as well: the scans of a frequent key go to several pieces, its cards to all of those."""
    n, m = F.col("n"), F.col("m")
    sizes = scans.groupBy(key).agg(F.count("*").alias("n")).join(cards.groupBy(key).agg(F.count("*").alias("m")), key)
    pieces = sizes.select(key, F.greatest(F.least(F.ceil(n * m / PAIRS), F.ceil(n / SCANS)), F.lit(1)).cast("int").alias("pieces"))
    left = scans.join(pieces, key).withColumn("piece", F.pmod(F.xxhash64("scan_id"), F.col("pieces")).cast("int")).drop("pieces")
    right = cards.join(pieces, key).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return left, right


def by_number(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (scan_id, id), once each: cards that share a number key or an alias with the scan's number (see ``text.number_key``).

    Pairs are not compared with each other: a pair that shares several keys, which takes a repeated scan_id
    and a repeated id, is made by the least of them.
    """
    asked = _all_keys(scans, "scan_id", text.number_key(number_query(F.col("collector_id"))))
    known = _all_keys(cards, "id", text.number_key(F.col("number"))).withColumnRenamed("keys", "others")
    n = _parts(cards)  # by number, since few rows make many pairs, which adaptive execution doesn't see
    asked, known = (x.repartition(n, "key", "piece") for x in dealt(asked, known, "key"))
    once = F.col("keys").isNull() | F.col("others").isNull() | (F.array_min(F.array_intersect("keys", "others")) == F.col("key"))
    return asked.join(known, ["key", "piece"]).where(once).select("scan_id", "id")


def fuzzy_names(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (root, known, score, place): for each distinct root that the catalogue lacks, its most similar roots.

    At most MOST with a similarity of LEAST or more, equal ones in descending order of the name. A
    similarity that rounds to LEAST is at least half a percent less, which bounds what two roots share.
    The catalogue's roots are prepared once each, so a pair costs a few operations for each character.
    """
    known = cards.select(F.lower(text.catalog_root(F.col("name"))).alias("known")).where("known != ''").distinct()
    asked = scans.where("ocr_name is not null").select(F.lower(text.catalog_root(F.col("ocr_name"))).alias("root")).where("root != ''").distinct()
    missing = asked.join(known, asked.root == known.known, "left_anti")
    met = similarity.alike_pairs(missing, known, "root", "known", (LEAST - 0.5) / 100)
    pairs = met.repartition(_parts(cards)).select("root", "known", _ratio("root", "known").alias("score"))
    order = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("known"))
    return pairs.where(F.col("score") >= LEAST).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)


def by_name(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (scan_id, id): cards with the scan's root name, or with the roots most like it where none has."""
    roots = cards.select("id", F.lower(text.catalog_root(F.col("name"))).alias("known")).where("known != ''")
    asked = scans.where("ocr_name is not null").select("scan_id", F.lower(text.catalog_root(F.col("ocr_name"))).alias("root"))
    fuzzy = fuzzy_names(scans, cards).select("root", "known")
    means = roots.select(F.col("known").alias("root"), "known").distinct().unionByName(fuzzy)
    return asked.join(means, "root").join(roots, "known").select("scan_id", "id").distinct()


def candidates(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (scan_id, id) found by number or by name, once each."""
    return by_number(scans, cards).unionByName(by_name(scans, cards)).distinct()


def with_any(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (scan_id): the scans that have a candidate. Keys decide; no pair of scan and card is made."""
    asked = scans.select("scan_id", text.number_key(number_query(F.col("collector_id"))).alias("key"), F.lower(text.catalog_root(F.col("ocr_name"))).alias("root"))
    numbers = cards.select(text.number_key(F.col("number")).alias("key")).where("key is not null").distinct()
    known = cards.select(F.lower(text.catalog_root(F.col("name"))).alias("root")).where("root != ''").distinct()
    roots = known.unionByName(fuzzy_names(scans, cards).select("root").distinct())
    return asked.join(numbers, "key", "left_semi").select("scan_id").unionByName(asked.join(roots, "root", "left_semi").select("scan_id")).distinct()


def fallback_chain(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (scan_id, step, kind, key): the first of these searches that finds any card.

    0 the local catalogue (``candidates``), 1 the exact name, 2 names that start with the root, 3 and 4
    with its first four and three letters, 5 the number, 6 the number's digits. Cards are not listed for
    each scan: scans with the same search share its result, see ``search_results``.
    """
    local = with_any(scans, cards).select("scan_id", F.lit(0).alias("step"), F.lit("local").alias("kind"), F.lit(None).cast("string").alias("key"))
    scans = scans.join(local.select("scan_id"), "scan_id", "left_anti")
    root, number = F.col("root"), F.col("number")
    step = lambda n, kind, key, ok: F.when(ok, F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), key.alias("key")))
    asked = scans.select("scan_id", F.lower(text.catalog_root(F.coalesce("ocr_name", F.lit("")))).alias("root"), number_query(F.col("collector_id")).alias("number"))
    searches = F.array(
        step(1, "name", root, root != ""),
        step(2, "start", root, root != ""),
        step(3, "start", F.substring(root, 1, 4), F.length(root) >= 4),
        step(4, "start", F.substring(root, 1, 3), F.length(root) >= 3),
        step(5, "number", number, number.isNotNull()),
        step(6, "number", text.no_zeros(text.digits(number)), number.isNotNull()),
    )
    tried = asked.select("scan_id", F.explode(searches).alias("s")).where("s is not null").select("scan_id", "s.*")
    finds = search_results(tried.select("kind", "key"), cards).select("kind", "key").distinct()
    first = tried.join(finds, ["kind", "key"]).groupBy("scan_id").agg(F.min(F.struct("step", "kind", "key")).alias("f"))
    return local.unionByName(first.select("scan_id", "f.*"))


def search_results(searches: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows (kind, key, id): what each distinct search (kind name, start or number) finds.

    A beginning is found among all beginnings of the names.
    """
    asked = searches.select("kind", "key").distinct()
    names = cards.select("id", F.lower("name").alias("name"))
    starts = names.where("name != ''").select("id", F.lit("start").alias("kind"), F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("key"))
    index = names.select("id", F.lit("name").alias("kind"), F.col("name").alias("key")).unionByName(starts).unionByName(cards.select("id", F.lit("number").alias("kind"), F.col("number").alias("key")))
    return asked.join(index, ["kind", "key"]).select("kind", "key", "id")


# ---------------------------------------------------------------- closed set of names


def closed_names(cards: DataFrame) -> DataFrame:
    """Rows (name, ord, key, root): distinct names in the order of their first card."""
    return cards.groupBy("name").agg(F.min("k").alias("ord")).select("name", "ord", text.clean_key(F.col("name")).alias("key"), text.closed_root(F.col("name")).alias("root"))


def exact_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (ocr_name, match) of names whose key the closed set has; the last name of a key wins."""
    last = names.groupBy("key").agg(F.max_by("name", "ord").alias("match"))
    return asked.select("ocr_name", text.clean_key(F.col("ocr_name")).alias("key")).where("key != ''").join(last, "key").select("ocr_name", "match")


def _pools(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (ocr_name, own, own_root, pool): for each spelling that no key equals, an array of (kind, ord, name, key, root); empty where nothing is near."""
    spelled = asked.select("ocr_name", text.clean_key(F.col("ocr_name")).alias("own"), text.closed_root(F.col("ocr_name")).alias("own_root")).where("own != ''")
    open_ = spelled.join(names.select(F.col("key").alias("own")).distinct(), "own", "left_anti")
    first = Window.partitionBy("root").orderBy("ord")
    placed = names.where("root != ''").withColumn("place", F.row_number().over(first))
    start = lambda c: F.when(F.length(c) >= 3, F.concat(F.lit("start "), F.substring(c, 1, 3)))
    keys = lambda c: F.array(F.concat(F.lit("root "), F.col(c)), start(F.col(c)))
    entry = F.struct(F.when(F.col("by").startswith("root"), 0).otherwise(1).alias("kind"), "ord", "name", "key", "root")
    known = placed.select("ord", "name", "key", "root", "place", F.explode(F.array(F.concat(F.lit("root "), F.col("root")), F.when(F.col("place") <= 5, F.concat(F.lit("start "), F.substring("root", 1, 3))))).alias("by")).where("by is not null")
    met = open_.select("ocr_name", "own", "own_root", F.explode(keys("own_root")).alias("by")).join(known.select("by", "root", entry.alias("e")), "by", "left")
    near = F.when(F.col("by").startswith("root") | (F.col("root") != F.col("own_root")), F.col("e"))
    return met.groupBy("ocr_name", "own", "own_root").agg(F.collect_list(near).alias("pool"))


def name_pool(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (ocr_name, name, kind): names of the same root (0), the first five of each root with the same three letters (1), or one row of kind 2 without a name, which stands for all names, where there are none."""
    return _pools(asked, names).select("ocr_name", F.explode_outer("pool").alias("e")).select("ocr_name", "e.name", F.coalesce("e.kind", F.lit(2)).alias("kind"))


def closed_set(asked: DataFrame, names: DataFrame, least: float = 0.55) -> DataFrame:
    """Rows (ocr_name, match, confidence) for every distinct spelling; no match has confidence 0.

    A spelling whose pool is all names meets those that can reach ``least``: the windows' ratio counts
    0.15 at most, so the names share a word, or their ratio or that of their sorted words is at least
    (least - 0.15) / 0.85, less what rounding gives.
    """
    exact = exact_names(asked, names).select("ocr_name", "match", F.lit(1.0).alias("confidence"))
    pools = _pools(asked, names)
    bound = (least - 0.15) / 0.85 - 0.02

    def keys(c, left):
        words = similarity.tokens(F.col(c))
        tagged = F.transform(words, lambda w: F.concat(F.lit("word "), w))
        return F.explode(F.array_union(F.array_union(tagged, similarity.alike_keys(F.col(c), bound, left)), similarity.alike_keys(F.array_join(words, " "), bound, left)))

    open_ = pools.where(F.size("pool") == 0).select("ocr_name", "own", "own_root")
    known = names.where("key != ''")
    able = open_.withColumn("by", keys("own", True)).join(known.select("key", keys("key", False).alias("by")), "by").select("ocr_name", "own", "own_root", "key").distinct()
    rest = able.join(known, "key").select("ocr_name", "own", "own_root", F.lit(2).alias("kind"), "ord", "name", "key", "root")
    pool = pools.select("ocr_name", "own", "own_root", F.explode("pool").alias("e")).select("ocr_name", "own", "own_root", "e.*").unionByName(rest).repartition(_parts(names))
    score = similarity.closed_set_score(F.col("own"), F.col("key"))
    same_root = (F.col("own_root") == F.col("root")) & (F.col("root") != "")
    scored = pool.select("ocr_name", "name", "kind", "ord", F.round(F.when(same_root, F.greatest(score, F.lit(0.85))).otherwise(score), 3).alias("score"))
    best = scored.groupBy("ocr_name").agg(F.max_by(F.struct("name", "score"), F.struct("score", (-F.col("kind")).alias("k"), (-F.col("ord")).alias("o"))).alias("b"))
    chosen = best.where(F.col("b.score") >= least).select("ocr_name", F.col("b.name").alias("match"), F.col("b.score").alias("confidence"))
    return asked.select("ocr_name").join(exact.unionByName(chosen), "ocr_name", "left").select("ocr_name", "match", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
