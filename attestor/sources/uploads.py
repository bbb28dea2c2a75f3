"""Uploads in multipart bodies: their parts, and what is refused and why."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an image and frames of a burst at most.
MOST_BYTES, MOST_FRAMES = 15 << 20, 20
_PART = "part_no int, field string, filename string, content_type string, content binary"
_BOUNDARY = re.compile(r'boundary=(?:"([^"]+)"|([^\s;]+))', re.I)
# What image files begin with.
SIGNATURES = ["89504E470D0A1A0A", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A"]


def split_parts(content_type: str | None, body: bytes | None) -> list[tuple]:
    """The parts (field, filename, content type, content) of a multipart body; one that is cut off ends where the body does."""
    found = _BOUNDARY.search(content_type or "")
    if found is None or not body or not (content_type or "").lower().startswith("multipart/"):
        return []
    mark = b"--" + (found.group(1) or found.group(2)).encode()
    out = []
    # a boundary stands at the start of a line; what is before the first and after the last isn't a part
    pieces = re.split(rb"(?:\A|\r\n)" + re.escape(mark), body)
    for piece in pieces[1:]:
        if piece.startswith(b"--"):
            break
        line, _, rest = piece.partition(b"\r\n")
        if line.strip(b" \t"):
            continue  # longer than the boundary
        head, gap, content = rest.partition(b"\r\n\r\n") if not rest.startswith(b"\r\n") else (b"", b"\r\n", rest[2:])
        if not gap:
            continue
        headers = {}
        for h in head.split(b"\r\n"):
            name, _, value = h.partition(b":")
            headers[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        told = headers.get(b"content-disposition", "")
        named = {k.lower(): v.replace('\\"', '"') for k, v in re.findall(r';\s*([\w*]+)="((?:[^"\\]|\\.)*)"', told)}
        out.append((named.get("name"), named.get("filename"), headers.get(b"content-type"), content))
    return out


def read_parts(requests: DataFrame) -> DataFrame:
    """Rows (request_id, part_no, field, filename, content_type, content) of ``requests`` (request_id, content_type, body)."""
    kind = requests.schema["request_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one body at a time: each may be as large as a burst
                rows = [(k, *p) for k, p in enumerate(split_parts(batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))]
                if rows:
                    ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["request_id", "part_no", "field", "filename", "content_type", "content"])

    return requests.select("request_id", "content_type", "body").mapInArrow(run, f"request_id {kind}, {_PART}")


def looks_like_image(content: Column) -> Column:
    """Whether bytes begin like a PNG, JPEG, GIF, BMP or TIFF file; only a decoder knows whether they are one."""
    start = F.hex(F.substring(content, 1, 8))
    return F.coalesce(F.greatest(*(start.startswith(s).cast("int") for s in SIGNATURES)) == 1, F.lit(False))


def judge_scans(parts: DataFrame, most_bytes: int = MOST_BYTES, decodable: Column | None = None) -> DataFrame:
    """Rows (request_id, status, detail): whether each part is an image that can be scanned, by the first rule that it breaks. ``decodable`` overrides the test of the content."""
    good = looks_like_image(F.col("content")) if decodable is None else decodable
    image = F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    size = F.octet_length("content")
    refusal = (
        F.when(~image, F.struct(F.lit(400).alias("status"), F.lit("File uploaded must be an image.").alias("detail")))
        .when(size > most_bytes, F.struct(F.lit(413).alias("status"), F.lit("Uploaded image is too large.").alias("detail")))
        .when(~good, F.struct(F.lit(400).alias("status"), F.lit("Could not decode image file.").alias("detail")))
        .otherwise(F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail")))
    )
    return parts.select("request_id", refusal.alias("r")).select("request_id", "r.status", "r.detail")


def judge_bursts(requests: DataFrame, parts: DataFrame, most_bytes: int = MOST_BYTES, most_frames: int = MOST_FRAMES) -> DataFrame:
    """Rows (request_id, status, detail, n_files, n_frames) of all ``requests``: a burst without files, with too many, or with one that is too large is refused; empty files aren't frames."""
    size = F.octet_length("content")
    counted = parts.groupBy("request_id").agg(F.count("*").alias("n_files"), F.count_if(size > 0).alias("n_frames"), F.max(size).alias("largest"))
    joined = requests.select("request_id").distinct().join(counted, "request_id", "left")
    n = F.coalesce("n_files", F.lit(0))
    status = F.when(n == 0, 400).when(n > most_frames, 413).when(F.col("largest") > most_bytes, 413).otherwise(200)
    detail = F.when(n == 0, "No files provided in burst stream.").when(n > most_frames, f"At most {most_frames} frames are allowed per burst.").when(F.col("largest") > most_bytes, "An uploaded frame is too large.")
    return joined.select("request_id", status.alias("status"), detail.alias("detail"), n.alias("n_files"), F.coalesce("n_frames", F.lit(0)).alias("n_frames"))


def frames_of(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (request_id, frame_no, content): the frames of the requests that aren't refused, in the order of their parts."""
    taken = verdicts.where("status = 200").select("request_id")
    return parts.join(taken, "request_id", "left_semi").where(F.octet_length("content") > 0).select("request_id", F.col("part_no").alias("frame_no"), "content")
