"""Line deduplication by a deletion-neighbourhood join.

A line is dropped if an earlier line of the corpus, by document id and line number, is equal or at
most one edit (insertion, deletion or substitution of a character) away. The steps:

1. Lines are folded to distinct ones by a 128-bit hash, with their first places.
2. A line of 16 or more characters has two anchors, somewhat less than half of it from either end;
   two lines one edit apart have equal first or equal last anchors, since the edit spoils one of
   them at most. Only lines whose anchor another line has go on.
3. The rest of such a line beyond its anchor is anchored and sifted once more in the same way. Then
   hashes of what is left, about a quarter of the line, and of all its variants with one character
   deleted are emitted. Equal hashes meet; the edit distance of the rests is then verified.
4. A distinct line stays if its first place is earlier than those of all its neighbours; each
   document gets the numbers of its lines that stay.

Boilerplate folds in step 1 with partial results, so a line that a third of all documents have is one
row. How many distinct lines can share a variant is bounded by the alphabet and not by the corpus.

Defined results: blank lines always stay; lines under 16 characters are dropped for equal lines only;
a null text stays null and has no lines; a document that loses all lines keeps an empty text; rows
that repeat an id with another text are documents of their own, ordered by a hash of the text; rows
that repeat both share their decisions; null ids come before all others; other columns are
kept as they are, but for n_lines and n_kept, which are replaced.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import written

#: Characters from which lines are compared by edits; white characters of a blank line; documents that are worked on at once.
FUZZY, WHITE, ROWS = 16, " \t\n\v\f\r", 256


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (id, doc, line, s) of all lines that aren't blank; ``docs`` has id, text and doc."""
    return docs.select("id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where(F.regexp_like("s", F.lit("\\S")))


def _anchors(s: Column, size: Column) -> Column:
    """Entries (key, m, head) for the anchors of a line; lines a character apart in length share those of one length m."""
    m = lambda n: (F.floor(n / 8) * 4).cast("int")
    lengths = F.array_distinct(F.array(m(size), m(size - 1)))
    ends = lambda k: F.array(
        F.struct(F.xxhash64(F.lit(1), k, F.substring(s, F.lit(1), k)).alias("key"), k.alias("m"), F.lit(True).alias("head")),
        F.struct(F.xxhash64(F.lit(2), k, F.substring(s, -k, k)).alias("key"), k.alias("m"), F.lit(False).alias("head")),
    )
    return F.when(size >= FUZZY, F.flatten(F.transform(lengths, ends)))


def variants(rest: str) -> list[tuple[int, str]]:
    """The string itself (-1), and for each place the string without the character there."""
    return [(-1, rest), *((k, rest[:k] + rest[k + 1 :]) for k in range(len(rest)))]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _rests(docs_with_entries: DataFrame, text_col: str) -> DataFrame:
    """Rows (key, id, doc, line, rest): for each entry, what is left of the line, less its own shared anchor, by that anchor.

    The rest of a line beyond its anchor is anchored once more in the same way, which leaves about a
    quarter of the line. The input is taken whole, so that its exchange is the one that the last join uses.
    """
    kind = docs_with_entries.schema["id"].dataType.simpleString()
    names = ["key", "id", "doc", "line", "rest"]

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            types = [pa.int64(), batch.schema.field("id").type, pa.int64(), pa.int32(), pa.string()]
            out = []
            texts = pc.struct_field(batch.column("row"), text_col)
            for i in range(batch.num_rows):
                place, lines = (batch.column("id")[i].as_py(), batch.column("doc")[i].as_py()), texts[i].as_py().split("\n")
                for e in batch.column("entries")[i].as_py():
                    line = lines[e["line"]]
                    rest = line[e["m"] :] if e["head"] else line[: len(line) - e["m"]]
                    seed = e["key"] & (2**64 - 1)
                    for m in {len(rest) // 8 * 4, max(len(rest) - 1, 0) // 8 * 4}:
                        cuts = [(b"h", rest[:m], rest[m:]), (b"t", rest[len(rest) - m :], rest[: len(rest) - m])]
                        for side, anchor, left in cuts if m else cuts[:1]:
                            out.append((xxh64_intdigest(b"%s%d " % (side, m) + anchor.encode(), seed) - 2**63, *place, e["line"], left))
                if len(out) > 20_000:
                    yield _batch(out, names, types)
                    out = []
            yield _batch(out, names, types)

    return docs_with_entries.mapInArrow(run, f"key long, id {kind}, doc long, line int, rest string")


def _emit(rests: DataFrame) -> DataFrame:
    """Rows (key, variant, gap, id, doc, line, rest): the deletion neighbourhood of each rest."""
    kind = rests.schema["id"].dataType.simpleString()
    names = ["key", "variant", "gap", "id", "doc", "line", "rest"]

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            types = [pa.int64(), pa.int64(), pa.int32(), batch.schema.field("id").type, pa.int64(), pa.int32(), pa.string()]
            out = []
            for key, id_, doc, line, rest in zip(*(batch.column(n).to_pylist() for n in ("key", "id", "doc", "line", "rest"))):
                seed = key & (2**64 - 1)
                out += [(key, xxh64_intdigest(v, seed) - 2**63, gap, id_, doc, line, rest) for gap, v in variants(rest)]
                if len(out) > 50_000:
                    yield _batch(out, names, types)
                    out = []
            yield _batch(out, names, types)

    return rests.select("key", "id", "doc", "line", "rest").mapInArrow(run, f"key long, variant long, gap int, id {kind}, doc long, line int, rest string")


def _later(near: DataFrame) -> DataFrame:
    """Places of lines that have an earlier neighbour, from rows of ``_emit``.

    Rows with equal variant and gap are a substitution apart from each other, so each is held against
    the earliest. A string that is another's variant is a deletion apart from it; there is one such
    string in a group, held against the earliest of the others and they against it. So the work is
    linear in the rows, whatever a group's size.
    """
    one = F.struct("place", "rest")
    same, group = Window.partitionBy("key", "variant", "gap"), Window.partitionBy("key", "variant")
    seen = (
        near.withColumn("place", F.struct("id", "doc", "line"))
        .withColumn("whole", F.min(F.when(F.col("gap") < 0, one)).over(group))
        .withColumn("part", F.min(F.when(F.col("gap") >= 0, one)).over(group))
        .withColumn("mate", F.min(F.when(F.col("gap") >= 0, one)).over(same))
    )
    before = lambda c: (F.col(f"{c}.place") < F.col("place")) & F.levenshtein(F.col("rest"), F.col(f"{c}.rest"), 1).between(0, 1)
    hit = F.when(F.col("gap") < 0, before("part")).otherwise(F.coalesce(before("mate"), F.lit(False)) | F.coalesce(before("whole"), F.lit(False)))
    return seen.where(hit).select("place").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns; ``text_col`` holds the lines that stay, and n_lines and n_kept are added.

    Columns of the input that have these two names are replaced.
    """
    docs = docs.drop("n_lines", "n_kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("doc"))
    lines = _lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc")))
    hashes = [F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("line"), "s").alias("h2")]
    distinct = written(lines.groupBy(*hashes).agg(F.min(F.struct("id", "doc", "line")).alias("place"), F.first(_anchors(F.col("s"), F.length("s"))).alias("anchors")).withColumn("name", F.struct("h1", "h2")).drop("h1", "h2"))
    # anchors that more than one distinct line has
    anchored = distinct.where("anchors is not null").select("name", "place", F.explode("anchors").alias("a")).select("name", "place", "a.*")
    shared = anchored.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low != high").select("key")
    # a document is told by its id and its hash: hashes alone meet by chance among very many
    owner = [F.col("place.doc").alias("of_doc"), F.col("place.id").alias("of_id")]
    same = (F.col("doc") == F.col("of_doc")) & F.col("id").eqNullSafe(F.col("of_id"))
    entries = anchored.join(shared, "key").groupBy(*owner).agg(F.collect_set(F.struct(F.col("place.line").alias("line"), "key", "m", "head")).alias("entries"))
    rests = _rests(keyed.join(entries, same).drop("of_doc", "of_id"), text_col)
    closer = rests.groupBy("key").agg(F.min(F.struct("id", "doc", "line")).alias("low"), F.max(F.struct("id", "doc", "line")).alias("high")).where("low != high").select("key")
    later = _later(_emit(rests.join(closer, "key")))
    stays = distinct.select("place").join(later, "place", "left_anti")
    kept = stays.groupBy(*owner).agg(F.collect_list("place.line").alias("keep"))
    joined = keyed.join(kept, same, "left").drop("of_doc", "of_id")
    schema = StructType([*docs.schema.fields, StructField("n_lines", IntegerType()), StructField("n_kept", IntegerType())])
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            columns = batch.column("row").flatten()
            texts, n_lines, n_kept = [], [], []
            for text, keep in zip(columns[place].to_pylist(), batch.column("keep").to_pylist()):
                all_lines = [] if text is None else text.split("\n")
                keep = set(keep or ())
                left = [s for k, s in enumerate(all_lines) if k in keep or not s.strip(WHITE)]
                texts.append(None if text is None else "\n".join(left))
                n_lines.append(len(all_lines))
                n_kept.append(len(left))
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_kept, pa.int32())], schema.names)

    return joined.mapInArrow(run, schema)
