"""The best candidates of each scan without scoring all of them.

Scores are sums of weighted evidence (total, number, name, hp).

Cards with a scan's number key meet it in groups, one for each key (or piece of a frequent one). A group scores
distinct printed ids against distinct kinds of number once, names once for each pair of spellings, and leaves
out the kinds of number whose bound doesn't reach the last place that counts. Its best are all that leaves it,
and the last of them is the scan's threshold.

Cards with the scan's root name but another number key are found through lists, indexed by the root and pieces
of evidence (a number that the scan's ends with or that ends with it, the total, the hp, being special). For a
scan each list has a bound: the greatest score of a card that is in it and in no list with more evidence. Only
lists whose bound reaches the threshold are read, the most promising first, which raises the threshold for the
others. A card that is in none of the lists read scores less than the threshold, so the best are whole, ties
included.

Cards that score alike for every scan (same name, number, total, hp and kind of set) compete by id alone, so
of each such class the first few enter. Lists without a number hold a few of each name for the same reason: a
card of them that scores more is in another list. Where an id of scans or cards is repeated, all candidates are
scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..shared import written
from . import candidates, scoring

#: Room for the rounding of scores.
SLACK = 1e-5
#: Pairs that a group scores at a time.
CHUNK = 1 << 20
#: Weights as whole numbers, so that sums are exact: total, number, name, hp.
_WHOLE = tuple(round(w * 1_000_000) for w in scoring.WEIGHTS)


def _fold(cards: DataFrame, most: int, *by: str) -> DataFrame:
    """The first ``most`` cards, by id, of each class."""
    return cards.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_place") <= most).drop("_place")


def asked_facts(scans: DataFrame) -> DataFrame:
    """What of a scan is compared, with its number key and root name."""
    return scoring._asked(scans).withColumns({"root": F.lower(text.catalog_root(F.col("ocr_name"))), "k": text.number_key(F.col("num_query"))})


def card_facts(cards: DataFrame, most: int) -> DataFrame:
    """What of a card is compared, with its number key and root name; the first few of each class."""
    facts = scoring._facts(cards).select(scoring.COMPARED + ["name", "number"])
    facts = _fold(facts, most, "c_name", "c", "c_families", "c_special", "has", "c_hp")  # number key and root follow from these
    return facts.withColumns({"k": text.number_key(F.col("number")), "root": F.lower(text.catalog_root(F.col("name")))}).drop("name", "number")


# ---------------------------------------------------------------- cards with the scan's number key


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The same whole numbers for equal values of several columns, -1 for null."""
    every, _ = pd.factorize(np.concatenate([c.to_numpy(zero_copy_only=False) for c in columns]).astype(object))
    return np.split(every, np.cumsum([len(c) for c in columns])[:-1])


def _best_of_group(table: pa.Table, most: int, schema: pa.Schema) -> pa.Table:
    """The best cards of each scan of a group; its rows are scans (kind 0), cards (1), and what printed ids and kinds of number have of each other (2)."""
    kind = table["kind"].to_numpy()
    scans, cards, prints = (table.filter(pa.array(kind == i)) for i in range(3))
    if not len(scans) or not len(cards):
        return schema.empty_table()
    cards = cards.take(pc.sort_indices(cards["id"]))  # equal scores are ranked by place
    n_cards = len(cards)
    a, a_of = _codes(scans["x"], prints["x"])
    b, b_of = _codes(cards["y"], prints["y"])
    cell = np.zeros((a.max() + 1, b.max() + 1), np.int32)
    cell[a_of, b_of] = np.arange(len(prints))
    total, num = (prints[c].to_numpy() for c in ("total_score", "num_score"))
    by_print = np.rint(total).astype(np.int64) * _WHOLE[0] + np.rint(num).astype(np.int64) * _WHOLE[1]
    (m,), (n,) = _codes(scans["name"]), _codes(cards["name"])
    q_names, c_names = ([None] * (codes.max(initial=-1) + 1) for codes in (m, n))
    for names, codes, column in ((q_names, m, scans["name"]), (c_names, n, cards["name"])):
        first = np.unique(codes[codes >= 0], return_index=True)[1]
        for code, name in zip(range(len(names)), column.filter(pc.is_valid(column)).take(first).to_pylist()):
            names[code] = name
    like = np.full((len(q_names) + 1, len(c_names) + 1), -1, np.int16)  # filled where it is needed; -1 as a code is the last row or column
    like[-1, :] = like[:, -1] = 0
    hp, c_hp = (pc.fill_null(x["hp"].cast(pa.int64()), gone).to_numpy() for x, gone in ((scans, 1 << 40), (cards, 1 << 41)))  # a missing one equals none

    order = np.argsort(a, kind="stable")
    edges = np.flatnonzero(np.diff(a[order], prepend=-1, append=a.max() + 1))
    best = np.full((len(a), most), -1, np.int64)  # score times number of cards, and cards after this one
    for i, j in zip(edges[:-1], edges[1:]):
        mine, levels = order[i:j], by_print[cell[a[order[i]]]][b]
        for level in np.unique(levels)[::-1]:
            open_ = mine[best[mine, -1] // n_cards <= level + 100 * (_WHOLE[2] + _WHOLE[3])]
            if not len(open_):
                break
            at = np.flatnonzero(levels == level)
            for k in range(0, len(open_), max(1, CHUNK // len(at))):
                some = open_[k : k + max(1, CHUNK // len(at))]
                rows, columns = np.unique(m[some]), np.unique(n[at])
                lacking = np.argwhere(like[np.ix_(rows, columns)] < 0)
                for r, c in zip(rows[lacking[:, 0]].tolist(), columns[lacking[:, 1]].tolist()):
                    like[r, c] = similarity.alike(q_names[r], c_names[c])
                score = like[np.ix_(m[some], n[at])] * np.int64(_WHOLE[2])
                score += (hp[some][:, None] == c_hp[at][None, :]) * np.int64(100 * _WHOLE[3])
                score += level
                score *= n_cards
                score += n_cards - 1 - at
                if score.shape[1] > most:
                    score = np.partition(score, score.shape[1] - most, axis=1)[:, -most:]
                best[some] = -np.sort(-np.concatenate([best[some], score], axis=1), axis=1)[:, :most]
    row, place = np.nonzero(best >= 0)
    card = n_cards - 1 - best[row, place] % n_cards
    of = pa.array(cell[a[row], b[card]])
    out = {
        "scan_id": scans["scan_id"].take(pa.array(row)), "id": cards["id"].take(pa.array(card)), "total_score": prints["total_score"].take(of), "num_score": prints["num_score"].take(of),
        "name_score": pa.array(like[m[row], n[card]].astype(np.float64)), "hp_score": pa.array(np.where(hp[row] == c_hp[card], 100.0, 0.0)), "no_total": prints["no_total"].take(of), "special": prints["special"].take(of),
    }
    return pa.table([pa.chunked_array(v) if isinstance(v, list) else v for v in out.values()], schema.names).cast(schema)


def by_number(asked: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """Rows (scan_id, id, columns of scoring.SCORES): each scan's best among the cards with its number key, ties by id."""
    keyed = lambda rows: rows.where("k is not null")
    left, right = candidates.dealt(keyed(asked), keyed(facts), "k")
    number = F.concat_ws("\x1f", "c", F.col("c_families").cast("string"), F.coalesce("c_special", F.lit(False)).cast("string"), F.coalesce("has", F.lit("")))
    where = ["k", "piece"]
    prints = left.select(*where, "collector_id", *(c for c in scoring.ASKED if c not in ("scan_id", "q_name", "ocr_hp"))).dropDuplicates([*where, "collector_id"])
    numbers = right.select(*where, number.alias("y"), *(c for c in scoring.COMPARED if c not in ("id", "c_name", "c_hp"))).dropDuplicates([*where, "y"])
    rows = [
        left.select(*where, F.lit(0).alias("kind"), "scan_id", F.col("collector_id").alias("x"), F.col("q_name").alias("name"), F.when(F.col("ocr_hp") != 0, F.col("ocr_hp")).alias("hp")),
        right.select(*where, F.lit(1).alias("kind"), "id", number.alias("y"), F.col("c_name").alias("name"), F.col("c_hp").alias("hp")),
        scoring.by_print(prints.join(numbers, where)).select(*where, F.lit(2).alias("kind"), F.col("collector_id").alias("x"), "y", "total_score", "num_score", "no_total", "special"),
    ]
    every = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    of = asked.schema["scan_id"].dataType.simpleString()
    id_type = of if of in kinds else "string"
    scored = {c: ("double", pa.float64()) for c in ("total_score", "num_score", "name_score", "hp_score")} | {c: ("boolean", pa.bool_()) for c in ("no_total", "special")}
    schema = pa.schema([("scan_id", kinds[id_type]), ("id", pa.string()), *((c, t) for c, (_, t) in scored.items())])

    def run(table: pa.Table) -> pa.Table:
        return _best_of_group(table, most, schema)

    ready = every.withColumn("scan_id", F.col("scan_id").cast(id_type)).repartition(candidates._parts(facts), *where)
    found = ready.groupBy(*where).applyInArrow(run, f"scan_id {id_type}, id string, " + ", ".join(f"{c} {t}" for c, (t, _) in scored.items()))
    return scoring.weighed(found.withColumn("scan_id", F.col("scan_id").cast(asked.schema["scan_id"].dataType)))


# ---------------------------------------------------------------- cards with the scan's root and another number key


def _key(kind: str, *values) -> Column:
    """A list's key; null where a value is."""
    return F.concat(F.lit(kind), *(x for v in values for x in (F.lit("\x1f"), v.cast("string"))))


def card_lists(facts: DataFrame, most: int) -> DataFrame:
    """Rows (key, id): the lists that each card is in, by its root and number (kinds N), or by its root and being special (kinds S)."""
    rooted = facts.where("root != ''").withColumn("s", F.coalesce("c_special", F.lit(False)).cast("int")).repartition(candidates._parts(facts), "id")
    root, c, s, has, hp = (F.col(x) for x in ("root", "c", "s", "has", "c_hp"))
    kinds = lambda kind, value: F.array(_key(f"{kind}TH", root, value, has, hp), _key(f"{kind}T", root, value, has), _key(f"{kind}H", root, value, hp), _key(kind, root, value))
    close = rooted.select("id", F.explode(kinds("N", c)).alias("key")).where("key is not null")
    wide = rooted.select("id", "c_name", has.isNull().alias("n"), F.explode(kinds("S", s)).alias("key")).where("key is not null")
    return close.unionByName(_fold(wide, most, "key", "c_name", "n").select("id", "key"))


def related_numbers(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (q, numbers): for each number asked for, the catalogue's numbers of another key that have something of it, as an array of (c, full); ``full`` are those that may score more than an ending."""
    q = asked.where("q is not null").select("q", "q_bare", "q_digits", "k").distinct()
    c = facts.where("c is not null").select("c", "c_bare", "c_digits", F.col("k").alias("c_k")).distinct()
    ends = lambda x: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(x, i, F.length(x)))))
    met = q.select("q", ends(F.col("q")).alias("c")).join(c.select("c"), "c").unionByName(c.select("c", ends(F.col("c")).alias("q")).join(q.select("q"), "q"))
    met = met.unionByName(q.select("q", F.col("q_digits").alias("d")).join(c.select("c", F.col("c_digits").alias("d")), "d").drop("d")).distinct()
    other = met.join(q, "q").join(c, "c").where(~F.col("k").eqNullSafe(F.col("c_k")))
    full = (F.col("q_digits") == F.col("c_digits")) | (F.col("q_bare") == F.col("c_bare"))
    return other.groupBy("q").agg(F.collect_set(F.struct("c", F.coalesce(full, F.lit(False)).alias("full"))).alias("numbers"))


def scan_lists(asked: DataFrame, roots: DataFrame, numbers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows (scan_id, lists): each scan's lists whose bound reaches its threshold, as an array of (key, bound)."""
    known = roots.groupBy("root").agg(F.collect_list("known").alias("knowns"))  # at most MOST of each
    wt, wn, wm, wh = (100 * w for w in scoring.WEIGHTS)
    most = wt + wn + wm + wh
    asked = asked.where("root != ''").join(known, "root").join(thresholds, "scan_id", "left").withColumn("least", F.coalesce("threshold", F.lit(0.0)) - SLACK)
    none = F.array().cast("array<string>")
    has_t = F.col("t").isNotNull()
    name = F.lit(wm)  # a scan with a root has a name
    exact = F.when(has_t, F.array_distinct(F.array("t", F.nullif("t_digits", F.lit(""))))).otherwise(none)
    # totals that are close: two off at most, or one digit off
    off = F.transform(F.array(*map(F.lit, (-2, -1, 1, 2))), lambda d: (F.col("t_number") + d).cast("string"))
    digits = F.array(*(F.lit(str(d)) for d in range(10)))
    changed = lambda i: F.transform(F.when(i == 1, F.array_append(digits, F.lit("-"))).otherwise(digits), lambda d: F.overlay("t_digits", d, i, F.lit(1)))
    one_off = F.when(F.length("t_digits").between(1, 11), F.flatten(F.transform(F.sequence(F.lit(1), F.length("t_digits")), changed))).otherwise(none)
    near = F.when(F.col("t_digits") != "", F.array_distinct(F.concat(off, one_off))).otherwise(none)
    special = F.when(has_t, 0.9 * wt).otherwise(0.8 * wt)  # of pairs that are special
    hp = F.when(F.col("ocr_hp") != 0, F.col("ocr_hp").cast("string"))
    entry = lambda key, bound: F.struct(key.alias("key"), bound.cast("double").alias("bound"))

    def lists(kind, root, value, number, totals, other):
        """Lists of a root and a number or kind, with ``totals`` as pairs of totals and what they are worth, ``other`` what any total is."""
        of = [F.flatten(F.transform(ts, lambda t: F.array(entry(_key(f"{kind}TH", root, value, t, hp), number + worth + name + wh), entry(_key(f"{kind}T", root, value, t), number + worth + name)))) for ts, worth in totals]
        return F.concat(*of, F.array(entry(_key(f"{kind}H", root, value, hp), number + other + name + wh), entry(_key(kind, root, value), number + other + name)))

    of_number = lambda r, n: lists("N", r, n["c"], F.when(n["full"], wn).otherwise(0.8 * wn), [(exact, wt)], F.when(n["full"], wt).otherwise(special))
    # numbers matter to scans whose threshold a card of another number key can reach
    able = F.when(F.exists("numbers", lambda n: n["full"]), most).otherwise(most - 0.2 * wn)
    some = F.when(able >= F.col("least"), F.col("numbers"))
    of_numbers = lambda r: F.flatten(F.transform(F.coalesce(some, F.array().cast("array<struct<c:string,full:boolean>>")), lambda n: of_number(r, n)))
    plain = lambda r: F.when(F.col("q_special"), F.array().cast("array<struct<key:string,bound:double>>")).otherwise(lists("S", r, F.lit(0), F.lit(0.0), [(exact, wt), (near, 0.6 * wt)], F.lit(0.0)))
    in_special = lambda r, s: lists("S", r, F.lit(s), F.lit(0.0), [(exact, wt)], special)
    any_special = lambda r: F.concat(in_special(r, 1), F.when(F.col("q_special"), in_special(r, 0)).otherwise(plain(r)))
    wide = F.when(wt + wm + wh >= F.col("least"), F.flatten(F.transform("knowns", any_special)))
    every = F.concat(F.flatten(F.transform("knowns", of_numbers)), F.coalesce(wide, F.array().cast("array<struct<key:string,bound:double>>")))
    # rows are few and much is made of each, which adaptive execution would put into one task
    ready = asked.join(numbers, "q", "left").where((F.col("least") <= wt + wm + wh) | (F.col("numbers").isNotNull() & (able >= F.col("least")))).repartition(candidates._parts(asked), "scan_id")
    kept = ready.select("scan_id", F.filter(every, lambda e: e["key"].isNotNull() & (e["bound"] >= F.col("least"))).alias("lists"))
    return kept.where(F.size("lists") > 0)


def _read(asked: DataFrame, wanted, lists: DataFrame) -> DataFrame:
    """Rows (scan_id, id): the cards of the wanted lists of each scan."""
    return asked.select("scan_id", F.explode(F.filter("lists", wanted)["key"]).alias("key")).join(lists, "key").select("scan_id", "id").distinct()


def _last(scored: DataFrame, most: int) -> DataFrame:
    """Rows (scan_id, threshold): the score of the last place that counts, of scans that have so many candidates."""
    return scoring.ranked(scored.select("scan_id", "id", "final_score"), most).where(F.col("place") == most).select("scan_id", F.col("final_score").alias("threshold"))


def contenders(scans: DataFrame, cards: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Scores (scan_id, id, columns of scoring.SCORES) of the candidates found first, and rows (scan_id, id) of those read for the threshold's sake: together they hold each scan's ``most`` best candidates.

    Facts, lists and first scores are written to the shared folder, since both searches need them.
    """
    facts, asked = written(card_facts(cards, most)), written(asked_facts(scans))
    if scoring.repeated(asked, "scan_id") or scoring.repeated(cards, "id"):
        every = scoring.scores(candidates.candidates(scans, cards), scans, cards)
        return every, every.select("scan_id", "id").limit(0)
    numbered = written(by_number(asked, facts, most))
    known = facts.select(F.col("root").alias("known")).where("known != ''").distinct()
    fuzzy = candidates.fuzzy_names(scans, cards).select("root", "known")
    roots = known.select(F.col("known").alias("root"), "known").unionByName(fuzzy)
    wanted = written(scan_lists(asked, roots, related_numbers(asked, facts), _last(numbered, most)))
    lists = written(card_lists(facts, most))
    top = wanted.withColumn("top", F.array_max(F.transform("lists", lambda e: e["bound"])) - SLACK)
    other = asked.select("scan_id", "k"), facts.select("id", F.col("k").alias("c_k"))

    def apart(pairs):
        """Without pairs that share a number key, which have been scored."""
        return pairs.join(other[0], "scan_id").join(other[1], "id").where(~F.col("k").eqNullSafe(F.col("c_k")) | F.col("k").isNull()).select("scan_id", "id")

    first = numbered.unionByName(written(scoring.scores(apart(_read(top, lambda e: e["bound"] >= F.col("top"), lists)), scans, cards)))
    judged = top.join(_last(first, most), "scan_id", "left")
    more = _read(judged, lambda e: (e["bound"] < F.col("top")) & (e["bound"] >= F.coalesce("threshold", F.lit(0.0)) - SLACK), lists)
    return first, apart(more).join(first, ["scan_id", "id"], "left_anti")


def best_evidence(scans: DataFrame, cards: DataFrame, most: int = 5) -> DataFrame:
    """What ``scoring.evidence`` has of each scan's ``most`` best candidates."""
    first, more = contenders(scans, cards, most)
    return scoring.with_cards(scoring.ranked(first.unionByName(scoring.scores(more, scans, cards)), most).drop("place"), cards)
