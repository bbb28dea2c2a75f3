"""The records of large JSON files, read by many tasks.

A file that is one array, however large, is read in splits that end at a closing brace, wherever that may be.
What a split's brackets mean depends on what stands before it: whether a string is open, and which brackets
are. So each split is first summarised, for both cases of the string, by the brackets that it closes but
does not open and those that it opens but does not close; such summaries compose, and composing them in
the order of the splits (one small row each) gives every split's start. Then each split gives its whole
records, and its pieces of those that reach over its ends; pieces of a record are put together by the
split in which it began.

Splits are those of Spark's text source, so they follow spark.sql.files.maxPartitionBytes, and files may lie
wherever Spark reads. Compressed files are one split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STRING = rb'"(?:[^"\\]|\\.)*"'
_TOKEN = re.compile(_STRING + rb'|"(?:[^"\\]|\\.)*\\?\Z|[\[\]{}]', re.S)
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
#: How far before a bracket its key is looked for.
KEY_BYTES = 200

Stack = tuple[str, ...]


def _tokens(data: bytes, in_string: bool) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the brackets outside of strings; at last (-1, b'1' or b'0'): whether a string is open at the end."""
    at, open_ = 0, False
    if in_string:
        found = _REST.match(data)
        if found is None:
            yield -1, b"1"
            return
        at = found.end()
    for m in _TOKEN.finditer(data, at):
        token = m.group()
        if token[0] != 34:
            yield m.start(), token
        elif len(token) < 2 or not re.fullmatch(_STRING, token, re.S):
            open_ = True
    yield -1, b"1" if open_ else b"0"


def _label(data: bytes, at: int, bracket: bytes) -> str:
    """An opening bracket with the key before it."""
    key = _KEY.search(data, max(0, at - KEY_BYTES), at)
    return bracket.decode() + (key.group(1).decode("utf-8", "replace") if key else "")


def summary(data: bytes, in_string: bool) -> tuple[bool, int, Stack]:
    """What some bytes do: whether a string is open after them, how many brackets they close that were open before, and which they leave open."""
    closed, opened, ends = 0, [], False
    for at, token in _tokens(data, in_string):
        if at < 0:
            ends = token == b"1"
        elif token in b"[{":
            opened.append(_label(data, at, token))
        elif opened:
            opened.pop()
        else:
            closed += 1
    return ends, closed, tuple(opened)


def compose(first: tuple[bool, int, Stack], then: tuple[bool, int, Stack]) -> tuple[bool, int, Stack]:
    """What two neighbouring stretches do together; ``then`` is the second one's summary for the string state after the first."""
    _, closed, opened = first
    ends, more, new = then
    kept = opened[: max(0, len(opened) - more)]
    return ends, closed + max(0, more - len(opened)), kept + new


def _at_level(stack: Stack, within: str | None) -> bool:
    """Whether an object that opens here is a record: in the outermost array, in the array ``within`` of the outermost object, or on a line of its own."""
    return stack == ("[",) or (stack == ("{", f"[{within}") if within is not None else stack == ())


def records(data: bytes, in_string: bool, stack: Stack, within: str | None) -> tuple[bytes | None, list[bytes], bytes | None]:
    """What a split holds: the end of a record that began before it, its whole records, the start of one that it doesn't end.

    A split inside one record gives all of itself as the end.
    """
    now, begin, head, whole = list(stack), None, None, []
    depth = next((d for d in range(len(stack)) if _at_level(stack[:d], within) and stack[d][0] == "{"), None)  # of the record that is open
    inside = depth is not None
    for at, token in _tokens(data, in_string):
        if at < 0:
            break
        if token in b"[{":
            if not inside and token == b"{" and _at_level(tuple(now), within):
                inside, begin, depth = True, at, len(now)
            now.append(_label(data, at, token))
        elif now:
            now.pop()
            if inside and len(now) == depth:
                if begin is None:
                    head = data[: at + 1]
                else:
                    whole.append(data[begin : at + 1])
                inside = False
    if inside and begin is None:
        return data, whole, None
    return head, whole, data[begin:] if inside else None


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, start, value): the text between closing braces, in order within each split."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _each_split(batches) -> Iterator[tuple[str, int, bytes]]:
    """The splits of a task one after another, as bytes."""
    held, parts = None, []
    for batch in batches:
        paths, starts, values = batch.columns
        for path, start, value in zip(paths.to_pylist(), starts.to_pylist(), values.to_pylist()):
            if held != (path, start):
                if held is not None:
                    yield *held, b"".join(parts)
                held, parts = (path, start), []
            parts += (value.encode(), b"}")
    if held is not None:
        yield *held, b"".join(parts)


def read_records(spark: SparkSession, path: str, within: str | None = None) -> DataFrame:
    """Rows (path, start, n, body): the JSON text of each record of the files below ``path``.

    Records are the objects of a file's array; with ``within`` also those of the array of that name in a
    file's object, else also objects that stand for themselves, one after another. ``start`` is the place
    of the split in which a record begins and ``n`` its number there, so that (path, start, n) is the
    order of the file. What isn't an object in an array is left out.

    The driver holds a summary of each split.
    """
    source = _splits(spark, path)

    def summarise(batches):
        for file, start, data in _each_split(batches):
            rows = [summary(data, s) for s in (False, True)]
            yield pa.RecordBatch.from_pylist([{"path": file, "start": start, "ends": [r[0] for r in rows], "closed": [r[1] for r in rows], "opened": [list(r[2]) for r in rows]}], _SUMMARY)

    found = source.mapInArrow(summarise, "path string, start long, ends array<boolean>, closed array<int>, opened array<array<string>>").collect()
    starts: dict[tuple[str, int], tuple[bool, Stack, int | None]] = {}
    state, began, last = (False, 0, ()), None, None
    for r in sorted(found, key=lambda r: (r["path"], r["start"])):
        if r["path"] != last:
            state, began, last = (False, 0, ()), None, r["path"]
        starts[r["path"], r["start"]] = state[0], state[2], began
        s = int(state[0])
        kept = len(state[2]) - r["closed"][s]
        state = compose(state, (r["ends"][s], r["closed"][s], tuple(r["opened"][s])))
        depth = next((d for d in range(len(state[2])) if _at_level(state[2][:d], within) and state[2][d][0] == "{"), None)
        if depth is not None and kept <= depth:  # the record open at the end began in this split
            began = r["start"]
    shared = spark.sparkContext.broadcast(starts)

    def split(batches):
        for file, start, data in _each_split(batches):
            in_string, stack, before = shared.value[file, start]
            head, whole, tail = records(data, in_string, stack, within)
            rows = [(file, start, i, None, x) for i, x in enumerate(whole)]
            if head is not None:
                rows.append((file, before, 1 << 40, start, head))
            if tail is not None:
                rows.append((file, start, 1 << 40, start, tail))  # the last that begins here
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, r)) for r in rows[k : k + 4096]], _PIECE)

    pieces = source.mapInArrow(split, "path string, start long, n long, part long, body binary")
    whole = pieces.where("part is null").select("path", "start", "n", F.decode("body", "utf-8").alias("body"))
    cut = pieces.where("part is not null").groupBy("path", "start", "n").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("ps"))
    joined = cut.select("path", "start", "n", F.decode(F.aggregate(F.transform("ps", lambda p: p["body"]), F.lit(b""), lambda a, b: F.concat(a, b)), "utf-8").alias("body"))
    return whole.unionByName(joined)


def with_positions(found: DataFrame) -> DataFrame:
    """What ``read_records`` gives with ``position``: the number of each record, from 0 on, in the order of the files. The driver holds a count of each split."""
    counts = sorted(found.groupBy("path", "start").count().collect(), key=lambda r: (r["path"], r["start"]))
    before, rows = 0, []
    for r in counts:
        rows.append((r["path"], r["start"], before))
        before += r["count"]
    offsets = found.sparkSession.createDataFrame(rows, "path string, start long, before long")
    own = F.row_number().over(Window.partitionBy("path", "start").orderBy("n"))
    return found.join(F.broadcast(offsets), ["path", "start"]).withColumn("position", (F.col("before") + own - 1).cast("long")).drop("before")


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.bool_())), ("closed", pa.list_(pa.int32())), ("opened", pa.list_(pa.list_(pa.string())))])
_PIECE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("body", pa.binary())])
