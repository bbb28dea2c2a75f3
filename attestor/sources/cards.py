"""Readers and writers of catalogues, images and listings."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_records import read_records, with_positions

CARD = (
    "id string, name string, hp string, number string, rarity string, set struct<id:string,name:string,series:string,printedTotal:int,total:int>, "
    "images struct<small:string,large:string>, tcgplayer struct<url:string,prices:map<string,struct<market:double>>>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a catalogue file: an object with ``cards``, or a bare list; an absent file gives no cards.

    A large file is read by many tasks (see ``read_records``), so cards come in no order.
    """
    try:
        found = read_records(spark, path, "cards")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CARD)
    return found.select(F.from_json("body", f"struct<{_fields()}>").alias("c")).select("c.*")


def _fields() -> str:
    return CARD.replace("id string, name string, hp string, number string, rarity string, set ", "id:string,name:string,hp:string,number:string,rarity:string,set:").replace(", images ", ",images:").replace(", tcgplayer ", ",tcgplayer:")


def read_card_files(spark: SparkSession, cards: str, sets: str) -> DataFrame:
    """Cards of one file for each set, ordered by id; a card without a set of its own gets that of the file's name from the file of sets."""
    listed = spark.read.schema(CARD).json(cards, multiLine=True).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    known = spark.read.schema("id string, name string, series string, printedTotal int, total int").json(sets, multiLine=True)
    joined = listed.join(known.select(F.col("id").alias("stem"), F.struct("*").alias("listed")), "stem", "left")
    return joined.withColumn("set", F.coalesce("set", "listed")).drop("stem", "listed").orderBy("id")


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of that name; whether it did. Of several writers one succeeds."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    if store.getUri().getScheme() == "file":  # Hadoop's own check for local files isn't atomic
        try:
            with os.fdopen(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = store.create(target, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """The commits of a catalogue: the version's folder by number."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    store = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(log):
        return {}
    names = sorted(f.getPath().getName() for f in store.listStatus(log) if re.fullmatch("[0-9]{20}", f.getPath().getName()))
    if not names:
        return {}
    read = spark.read.text([f"{path}/_commits/{n}" for n in names]).select(F.input_file_name().alias("file"), "value").collect()  # a line for each commit
    return {int(r["file"].rsplit("/", 1)[1]): r["value"] for r in read}


class CommitConflict(Exception):
    """Another writer has committed since the version that a write is based on."""


def last_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last commit; None where there is none."""
    return max(_commits(spark, path), default=None)


def write_catalog(cards: DataFrame, path: str, based_on: int | None = None) -> int:
    """Writes a catalogue as Parquet to a folder of its own and commits it; returns the commit's number.

    A commit is a small file, numbered and created only if absent, that names the folder; readers follow
    the highest number, so they see the old catalogue or the new one. With ``based_on`` (a number that
    ``last_version`` gave) the write holds only if nothing was committed since, else CommitConflict;
    without it a writer that loses the race takes the next number.
    """
    spark = cards.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    cards.write.parquet(f"{path}/{version}")
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    log.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(log)
    number = (last_version(spark, path) or 0) + 1 if based_on is None else based_on + 1
    while not _create(spark, f"{path}/_commits/{number:020d}", version + "\n"):
        if based_on is not None:
            raise CommitConflict(f"{path}: commit {number} is another writer's")
        number += 1
    return number


def read_written(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The catalogue of the last commit, or of the one with a number."""
    found = _commits(spark, path)
    if not found:
        raise FileNotFoundError(f"{path}: no commit")
    return spark.read.parquet(f"{path}/{found[max(found) if number is None else number]}")


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes the folders of all but the last ``keep`` commits; returns their numbers. The commits stay, so numbers aren't given again."""
    found = _commits(spark, path)
    gone = []
    for n in sorted(found)[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{found[n]}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.delete(folder, True):
            gone.append(n)
    return gone


def read_index(spark: SparkSession, metadata: str, vectors: str | None = None) -> DataFrame:
    """An embedding index: metadata rows (a JSON array or lines) with their embeddings.

    ``vectors`` (Parquet: position, embedding) is used if it has as many rows as the metadata; else the
    embeddings of the metadata themselves, and rows without one are left out.
    """
    fields = "card_id string, collector_id string, name string, hp int, set_name string, set_series string, rarity string, image_url string, embedding array<float>"
    typed = fields.replace(" string", ":string").replace(" int", ":int").replace(" array", ":array").replace(", ", ",")
    listed = with_positions(read_records(spark, metadata)).select("position", F.from_json("body", f"struct<{typed}>").alias("m")).select("position", "m.*")
    if vectors is not None:
        stored = spark.read.parquet(vectors).select("position", F.col("embedding").alias("stored"))
        if stored.count() == listed.count():
            return listed.drop("embedding").join(stored, "position").withColumnRenamed("stored", "embedding")
    return listed.where("embedding is not null")


def fetch_cards(searches: DataFrame, get: Callable[[str], list[dict] | None], attempts: int = 3, wait: float = 0.4) -> DataFrame:
    """Rows (search, card): the cards that a remote catalogue finds for each distinct ``search``.

    ``get`` asks it and returns the cards as dictionaries; None or an exception is a failure, tried again
    after ``wait`` seconds, then twice as long, and so on, ``attempts`` times in all. A distinct search is
    asked once, so the result is the cache of all scans that share it; a search that failed has no row
    and is asked again next time.
    """

    def run(batches):
        for batch in batches:
            out = []
            for search in batch["search"]:
                for n in range(attempts):
                    try:
                        found = get(search)
                    except Exception:  # a remote's failures are of any kind
                        found = None
                    if found is not None:
                        out += [(search, json.dumps(card)) for card in found] or [(search, None)]
                        break
                    if n + 1 < attempts:
                        time.sleep(wait * (n + 1))
            yield pd.DataFrame(out, columns=["search", "body"])

    asked = searches.select("search").where("search is not null").distinct()
    return asked.mapInPandas(run, "search string, body string").select("search", F.from_json("body", f"struct<{_fields()}>").alias("card"))


def unseen(searches: DataFrame, known: DataFrame) -> DataFrame:
    """The searches that no earlier ``fetch_cards`` answered."""
    return searches.select("search").join(known.select("search").distinct(), "search", "left_anti").distinct()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (rows of BGR); files that can't be decoded are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def uploads(files: DataFrame, most_bytes: int = 15 << 20, most_frames: int = 20) -> DataFrame:
    """Uploads (burst_id, content, ...) within the limits: not empty, not too large, not too many in a burst."""
    sized = files.where(F.length("content").between(1, most_bytes))
    return sized.withColumn("_n", F.count("*").over(Window.partitionBy("burst_id"))).where(F.col("_n") <= most_frames).drop("_n")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """Files below a path with one of the suffixes, in either case, images by default: name, size and time, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).orderBy("name")
