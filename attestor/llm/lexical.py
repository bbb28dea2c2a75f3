"""Ranked lexical search by presence masks.

Documents are read once, in slices, and kept as postings of the items' terms. In each slice an item's
documents are grouped by their presence mask: bit j tells whether the item's term j is there, and the masks
of all documents come from setting bits by posting list. A mask's greatest possible score is the sum, over
its terms, of the most that term adds to any document of the slice. Masks are evaluated in descending order
of it, until the best scores found so far (of all slices that a task has seen) beat the next mask's
greatest: what is left can't enter.

A task hands on at most ``most`` documents for each item; the items' best are merged by rank. Items are a
stated query set: they go to the tasks in blocks of about BLOCK bytes of text, and each block reads the
documents anew. The driver holds one block's items, its vocabulary and that vocabulary's document counts.

All arithmetic is on 64-bit integers but for a term's weight, whose logarithm is taken once, on the driver.

Defined results: null texts and texts without terms are no documents; items without terms, or whose terms
no document has, get no rows; each row of ``items`` is ranked by itself, so repeated items repeat their
rows; repeated documents rank each, equal scores by id, null ids last; other columns are ignored; empty
tables give no rows. Document ids are integers of up to 64 bits; other types are refused with a TypeError.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import slices, texts, written
from .decontaminate import WORDS

#: Bytes of item text in a block, about; bytes and documents of a slice.
BLOCK, SLICE, SLICE_ROWS = 16 << 20, 8 << 20, 16384
_POSTINGS = "n_docs long, n_words long, terms array<int>, df array<int>, ids binary, has_id binary, lengths binary, docs binary, tf binary"


class ItemBlock:
    """The items of a block: their names, their terms as numbers of the block's vocabulary."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        split = [(n, sorted(set(text.translate(WORDS).split()))) for n, text in rows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.items = [(n, np.array([self.vocabulary[w] for w in ws], np.int64)) for n, ws in split if ws]


def _slice(raw: list[bytes], ids: list, vocabulary: dict[bytes, int]):
    """Postings of a slice's documents: values of _POSTINGS."""
    get, names, lengths, docs, terms, tf = vocabulary.get, [], [], [], [], []
    for name, text in zip(ids, raw):
        words = text.translate(WORDS).split()
        if not words:
            continue
        counts = Counter(words)
        found = [(t, c) for t, c in zip(map(get, counts), counts.values()) if t is not None]
        terms += [t for t, _ in found]
        tf += [c for _, c in found]
        docs.append(len(found))
        names.append(name)
        lengths.append(len(words))
    term = np.array(terms, np.int64)
    order = np.argsort(term, kind="stable")
    distinct, df = np.unique(term, return_counts=True)
    doc = np.repeat(np.arange(len(names)), docs).astype(np.int32)[order]
    has = np.array([x is not None for x in names], bool)
    pack = lambda x, kind: np.asarray(x, kind).tobytes()
    return len(names), sum(lengths), distinct.tolist(), df.tolist(), pack([x or 0 for x in names], np.int64), pack(has, bool), pack(lengths, np.int64), pack(doc, np.int32), pack(np.array(tf, np.int64)[order], np.int32)


def postings(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """A row for each slice of documents, written to the shared folder: what its documents hold of the vocabulary of ``block`` (a broadcast ItemBlock)."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.binary()] * 5
        names = [x.split()[0] for x in _POSTINGS.split(", ")]
        for whole in batches:
            for some in slices(whole, "text", SLICE):
                for at in range(0, some.num_rows, SLICE_ROWS):
                    batch = some.slice(at, SLICE_ROWS)
                    row = _slice(texts(batch.column(1)), batch.column(0).to_pylist(), block.value.vocabulary)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _POSTINGS))


def masks_of(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, int]:
    """The number of each document's mask, and how many there are; documents of equal masks share it. ``lists`` holds each term's documents."""
    group, count = np.zeros(n, np.int64), 1
    for k in range(0, len(lists), 64):
        word = np.zeros(n, np.uint64)
        for j, docs in enumerate(lists[k : k + 64]):
            word[docs] |= np.uint64(1) << np.uint64(j)
        distinct, number = np.unique(word, return_inverse=True)
        group, count = number if count == 1 else np.unique(group * len(distinct) + number, return_inverse=True)[1], 0
        count = int(group.max()) + 1 if n else 0
    return group, count


class Slice:
    """The postings of a slice with what each occurrence adds, before weights."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        read = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, self.has_id, lengths = read("ids", np.int64), read("has_id", bool), read("lengths", np.int64)
        self.terms = np.asarray(row["terms"], np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.asarray(row["df"], np.int64))])
        self.docs, tf = read("docs", np.int32).astype(np.int64), read("tf", np.int32).astype(np.int64)
        m = 10 + 90 * lengths * n_docs // n_words
        self.adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.most = np.maximum.reduceat(self.adds, self.at[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def best(self, item: np.ndarray, weights: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of documents, among them all that can be of the ``most`` best and reach ``floor``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.searchsorted(self.terms, item)
        here = (where < len(self.terms)) & (self.terms[np.minimum(where, len(self.terms) - 1)] == item) if len(self.terms) else np.zeros(len(item), bool)
        where, weights = where[here], weights[here]
        if not len(where) or int((weights * self.most[where]).sum()) < floor:
            return none
        spans = [slice(self.at[t], self.at[t + 1]) for t in where.tolist()]
        lists = [self.docs[s] for s in spans]
        group, count = masks_of(lists, len(self.ids))
        member = np.zeros(count, np.int64)
        member[group] = np.arange(len(group))  # a document of each mask
        bound_of = np.zeros(len(group), np.int64)
        for docs, w, top in zip(lists, weights.tolist(), self.most[where].tolist()):
            bound_of[docs] += w * top
        bound = bound_of[member]
        order = np.argsort(-bound, kind="stable")
        bound, rank = bound[order], np.empty(count, np.int64)
        rank[order] = np.arange(count)
        place = rank[group]  # of each document's mask, by descending bound
        upto = np.cumsum(np.bincount(place, minlength=count))
        score, done, step = np.zeros(len(group), np.int64), 0, 2 * most
        found_scores, found_docs = none
        while done < count and bound[done] >= max(floor, 1):
            end = min(count, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step)) + 1)
            chosen = (place >= done) & (place < end)
            for docs, s, w in zip(lists, spans, weights.tolist()):
                some = chosen[docs]
                score[docs[some]] += w * self.adds[s][some]
            docs = np.flatnonzero(chosen)
            found_scores, found_docs = np.append(found_scores, score[docs]), np.append(found_docs, docs)
            if len(found_scores) >= most:
                floor = max(floor, int(np.partition(found_scores, len(found_scores) - most)[len(found_scores) - most]))
            done, step = end, 2 * step
        kept = (found_scores > 0) & (found_scores >= floor)
        return found_scores[kept], found_docs[kept]


def search(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item, rank, id, score): each item's ``most`` documents with the highest scores above 0."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: ids are integers, not {docs.schema[id_col].dataType.simpleString()}")
    asked = written(items.select(F.monotonically_increasing_id().alias("n"), F.col(item_col).alias("item"), F.col(item_text).alias("text")))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    blocks = -(-size // BLOCK) or 1
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).select("n", "text")
        rows = _search_block(docs, [(r["n"], (r["text"] or "").encode()) for r in part.collect()], most, id_col, text_col)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("n").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(asked.select("n", "item"), "n").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, rows: list[tuple[int, bytes]], most: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (n, id, score): at most ``most`` documents for each item and task."""
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(ItemBlock(rows))
    posted = postings(docs, block, id_col, text_col)
    n_docs, n_words = posted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = np.zeros(len(block.value.vocabulary), np.int64)
    for r in posted.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():  # as many as the block's vocabulary
        df[r["terms"]] = r["df"]
    weight = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))

    def run(batches):
        held = {n: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for n, _ in block.value.items}
        floors = dict.fromkeys(held, 1)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_docs"]:
                    continue
                part = Slice(row, n_docs, n_words)
                for n, item in block.value.items:
                    scores, places = part.best(item, weight.value[item], most, floors[n])
                    if not len(scores):
                        continue
                    score, ids, has = (np.append(a, b) for a, b in zip(held[n], (scores, part.ids[places], part.has_id[places])))
                    order = np.lexsort((ids, ~has, -score))[:most]
                    held[n] = score[order], ids[order], has[order]
                    if len(order) == most:
                        floors[n] = int(score[order[-1]])
        out = [(np.full(len(s), n), i, h, s) for n, (s, i, h) in held.items() if len(s)]
        if out:
            n, ids, has, score = map(np.concatenate, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.int64(), mask=~has), pa.array(score, pa.int64())], ["n", "id", "score"])

    dealt = posted.select("n_docs", "terms", "df", "ids", "has_id", "lengths", "docs", "tf")
    return dealt.mapInArrow(run, "n long, id long, score long")
