"""WARC archives with a two-level capture index.

Archives are gzip members, one for each record, so that a record is read by its place and length alone.
Of records with equal payloads of at least ``least`` bytes one is a response, the others are revisits
without payload; smaller ones are all responses.

The index has two levels. Captures are sorted by their URL's key (host reversed, then the rest) over all
of Spark's partitions; each partition writes its lines in compressed blocks, and a sparse directory with
the first key of each block. A lookup finds the shards whose keys can hold the one asked for, searches the
directory for its blocks, searches those for its lines, and reads the records they point to by range.

Payloads move once for each distinct one: equal ones meet in partial aggregation first. What else is
exchanged is a line for each capture. Files have names of their own for each attempt of a task and are
listed by tables that Spark commits, so a lost executor leaves files that nothing points to.

Defined results: null and empty payloads are empty responses; a null URL has the empty key; null ids come
last where the smallest is taken; rows that repeat another are captures of their own, and of equal large
ones exactly one is the response (smallest id, then smallest URL); an empty table gives no record; other
columns are ignored. Ids may be of any type that casts to a string and back.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_file, partitions, save, shared_dir, slices, texts, written

#: Bytes of an archive after which a task begins another; lines of an index block; bytes that one read of an archive may take.
ARCHIVE_BYTES, BLOCK_LINES, READ_BYTES = 64 << 20, 512, 4 << 20
_CRLF = b"\r\n"
_CAPTURE = "key string, id string, url string, file string, place long, size long"
_RECORD = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def url_key(url):
    """The sort key of a URL: its host in lower case with the labels reversed, then what follows; white space is percent-encoded."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(url)
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substring(rest, F.length(raw) + 1, F.length(rest)))
    for plain, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(plain), F.lit(code))
    return F.coalesce(key, F.lit(""))


# ---------------------------------------------------------------- records


def _line(value: str) -> bytes:
    """A header's value, on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def record_id(page: str | None, url: str | None, digest: str) -> str:
    """The id of the response that holds a payload, which revisits can name without having seen it."""
    return f"urn:uuid:{uuid.UUID(hashlib.sha256(repr((page, url, digest)).encode()).hexdigest()[:32])}"


def pack_record(kind: str, page: str | None, url: str | None, digest: str, size: int, payload: bytes, date: str, first: tuple | None = None) -> bytes:
    """A response with its payload, or a revisit of ``first`` (page, url), as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    own = record_id(page, url, digest) if kind == "response" and first else f"urn:uuid:{uuid.uuid4()}"
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <%s>" % own.encode(), b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    if page is not None:
        head.append(b"X-Page-ID: " + _line(page))
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <%s>" % record_id(*first, digest).encode()]
        if first[1] is not None:
            head.append(b"WARC-Refers-To-Target-URI: " + _line(first[1]))
        if first[0] is not None:
            head.append(b"X-Refers-To-Page-ID: " + _line(first[0]))
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return gzip.compress(_CRLF.join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid4()).encode(), b"WARC-Date: " + date.encode(), b"WARC-Filename: " + name.encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(body)]
    return gzip.compress(_CRLF.join(head) + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def unpack_record(member: bytes) -> tuple:
    """The fields of _RECORD of one gzip member; a response's payload is held against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(_CRLF)
    fields = dict(x.split(b": ", 1) for x in lines[1:])
    block = rest[: int(fields[b"Content-Length"])]
    if lines[0] != b"WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    text = lambda k: fields[k].decode() if k in fields else None
    return text(b"X-Page-ID"), size, digest, kind, text(b"X-Refers-To-Page-ID"), text(b"WARC-Target-URI"), payload if kind == "response" else None


# ---------------------------------------------------------------- writing


def _records(pages: DataFrame, least: int) -> DataFrame:
    """One row for each record to write: id, url, digest, size, kind, payload, and of whom it is a copy."""
    facts = pages.select("id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    facts = facts.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    large = facts.where(F.col("size") >= least)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    none = F.lit(None).cast("string")
    alone = facts.where(F.col("size") < least).select("id", "url", "digest", "size", F.lit("response").alias("kind"), "payload", F.lit(False).alias("shared"), none.alias("first_id"), none.alias("first_url"))
    # equal payloads meet before the exchange; each distinct one is exchanged once for each task that has it
    kept = large.groupBy("digest").agg(F.min(order).alias("f"), F.any_value("size").alias("size"), F.any_value("payload").alias("payload"))
    responses = kept.select("f.id", "f.url", "digest", "size", F.lit("response").alias("kind"), "payload", F.lit(True).alias("shared"), none.alias("first_id"), none.alias("first_url"))
    seen = written(large.groupBy("digest", "size", "id", "url").agg(F.count("*").alias("copies")))
    firsts = seen.groupBy("digest").agg(F.min(order).alias("f")).select("digest", F.col("f.id").alias("first_id"), F.col("f.url").alias("first_url"))
    itself = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    left = seen.join(firsts, "digest").withColumn("more", F.col("copies") - itself.cast("long")).where("more > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))
    revisits = left.select("id", "url", "digest", "size", F.lit("revisit").alias("kind"), F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("shared"), F.col("first_id").cast("string"), "first_url")
    text_id = lambda df: df.withColumn("id", F.col("id").cast("string"))
    return text_id(alone).unionByName(text_id(responses)).unionByName(text_id(revisits))


def write(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives below ``where``; a row for each record: key, id, url, file, place, size."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    names = [x.split()[0] for x in _CAPTURE.split(", ")][1:]

    def run(batches):
        store, base = fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for whole in batches:
                for batch in slices(whole, "payload"):
                    ids, urls, digests, sizes, kinds, _, shared, first_ids, first_urls = batch.columns
                    rows = zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), sizes.to_pylist(), kinds.to_pylist(), texts(batch.column(5)), shared.to_pylist(), first_ids.to_pylist(), first_urls.to_pylist())
                    found = []
                    for page, url, digest, size, kind, payload, common, first_id, first_url in rows:
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name = f"capture-{uuid.uuid4().hex}.warc.gz"
                            out, info = store.open_output_stream(f"{base}/{name}", compression=None), _info(name, date)
                            out.write(info)
                            at = len(info)
                        first = (first_id, first_url) if kind == "revisit" else (page, url) if common else None
                        member = pack_record(kind, page, url, digest, size, payload, date, first)
                        out.write(member)
                        found.append((page, url, name, at, len(member)))
                        at += len(member)
                    kinds = [pa.string()] * 3 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
        finally:
            if out is not None:
                out.close()

    made = _records(pages, least).mapInArrow(run, _CAPTURE.removeprefix("key string, "))
    return written(made, f"{where}-manifest").select(url_key(F.col("url")).alias("key"), *names)


def index(captures: DataFrame, where: str) -> DataFrame:
    """Writes the index of ``captures`` below ``where``; a row for each of its shards: name, least and greatest key, blocks, lines.

    A key of very many captures spans several shards.
    """
    spark = captures.sparkSession
    order = ["key", "id", "file", "place"]
    ordered = captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("key", "id", "file", "place", "size")

    def run(batches):
        store, base = fs.FileSystem.from_uri(where)
        name, out, directory = f"index-{uuid.uuid4().hex}", None, []
        lines: list[tuple[bytes, bytes]] = []
        at = n = 0
        last = b""

        def flush():
            nonlocal out, lines, at, n, last
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.blocks", compression=None)
            block = gzip.compress(b"\n".join(k + b" " + v for k, v in lines), 4, mtime=0)
            directory.append([lines[0][0].decode(), at, len(block)])
            out.write(block)
            at, n = at + len(block), n + len(lines)
            last, lines = lines[-1][0], []

        for batch in batches:
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append((key.encode(), json.dumps(rest).encode()))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            save(where, f"{name}.directory", json.dumps(directory).encode())
            values = [name, directory[0][0], last.decode(), len(directory), n]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["name", "least", "greatest", "blocks", "lines"])

    return written(ordered.mapInArrow(run, "name string, least string, greatest string, blocks long, lines long"), f"{where}-index-manifest")


# ---------------------------------------------------------------- reading


@lru_cache(maxsize=2)
def _directory(where: str, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    rows = json.loads(load_file(where, f"{name}.directory"))
    return [k.encode() for k, _, _ in rows], [(a, n) for _, a, n in rows]


def lookup(shards: DataFrame, where: str, keys: DataFrame) -> DataFrame:
    """Rows (key, id, file, place, size): the captures of each distinct ``key``.

    The driver holds one row for each shard of the index, which are as many as its writing job had partitions.
    """
    spark = keys.sparkSession
    known = sorted((r["least"].encode(), r["greatest"].encode(), r["name"]) for r in shards.select("name", "least", "greatest").collect())
    least, greatest, names = ([r[i] for r in known] for i in range(3))

    def route(batches):
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                found += ((names[i], key) for i in range(bisect_left(greatest, raw), bisect_right(least, raw)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found) if found else ([], []))], ["name", "key"])

    def search(batches):
        store, base = fs.FileSystem.from_uri(where)
        held, block, lines = None, [], []
        shard, source = None, None
        for batch in batches:
            found = []
            for name, key in zip(*(c.to_pylist() for c in batch.columns)):
                raw = key.encode()
                if name != shard:
                    if source is not None:
                        source.close()
                    shard, source, held = name, store.open_input_file(f"{base}/{name}.blocks"), None
                firsts, places = _directory(where, name)
                for b in range(max(0, bisect_left(firsts, raw) - 1), bisect_right(firsts, raw)):
                    if held != b:
                        lines = zlib.decompress(source.read_at(places[b][1], places[b][0]), 31).split(b"\n")
                        held, block = b, [x.partition(b" ")[0] for x in lines]
                    for x in lines[bisect_left(block, raw) : bisect_right(block, raw)]:
                        found.append((key, *json.loads(x.partition(b" ")[2])))
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "id", "file", "place", "size"])
        if source is not None:
            source.close()

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(route, "name string, key string")
    dealt = asked.repartition(partitions(spark), "name").sortWithinPartitions("name", "key")
    return dealt.mapInArrow(search, "key string, id string, file string, place long, size long")


def read(entries: DataFrame, where: str) -> DataFrame:
    """The records that ``entries`` (file, place, size) point to: id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Records that lie side by side are read together, up to READ_BYTES at a time.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(where)
        name, source = None, None
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            asked = list(zip(*(c.to_pylist() for c in batch.columns)))
            k = 0
            while k < len(asked):
                file, begin, size = asked[k]
                end, upto = begin + size, k + 1
                while upto < len(asked) and asked[upto][0] == file and asked[upto][1] == end and end - begin < READ_BYTES:
                    end, upto = end + asked[upto][2], upto + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                data = source.read_at(end - begin, begin)
                rows, held = [], 0
                for _, at, n in asked[k:upto]:
                    rows.append(unpack_record(data[at - begin : at - begin + n]))
                    held += rows[-1][1]
                    if held >= 4 * READ_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)
                k = upto
        if source is not None:
            source.close()

    dealt = entries.select("file", "place", "size").repartition(partitions(entries.sparkSession), "file").sortWithinPartitions("file", "place")
    return dealt.mapInArrow(run, _RECORD)


def write_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, where: str | None = None) -> DataFrame:
    """Writes archives and their index, by default to a new shared folder, and returns the records of all URLs as the index finds them: id, payload_bytes, payload_digest, record_type, refers_to."""
    where = where or shared_dir(pages.sparkSession)
    captures = write(pages, where, id_col, url_col, html_col, least)
    found = read(lookup(index(captures, where), where, captures), where)
    kind = pages.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
