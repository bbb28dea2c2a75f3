"""Multipart bodies against a writer, and refusals by the service's rules."""

import random
from email.mime.multipart import MIMEMultipart
from email.mime.nonmultipart import MIMENonMultipart

from attestor.sources import uploads

PNG = bytes.fromhex("89504E470D0A1A0A") + b"rest"


def body_of(parts, mark="mark"):
    out = [b"preamble\r\n" if parts and len(parts) % 2 else b""]
    for name, filename, kind, content in parts:
        head = f'Content-Disposition: form-data; name="{name}"' + (f'; filename="{filename}"' if filename is not None else "") + (f"\r\nContent-Type: {kind}" if kind else "")
        out.append(b"--" + mark.encode() + b"\r\n" + head.encode() + b"\r\n\r\n" + content + b"\r\n")
    return b"".join([*out, b"--" + mark.encode() + b"--\r\nepilogue"])


def test_parts_of_random_bodies():
    rng = random.Random(4)
    bits = [b"--mark", b"\r\n", b"--", b"mark", b"\r\n--mar", b"x", b"\0\xff", b"\r\n\r\n", b"--mark--"]
    for _ in range(300):
        parts = []
        for i in range(rng.randint(0, 4)):
            content = b"".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            if b"\r\n--mark" in content or content.startswith(b"--mark"):
                content = content.replace(b"--mark", b"--m rk")
            parts.append((f"f{i}", rng.choice([None, "a.png", "é;.jpg"]), rng.choice([None, "image/png"]), content))
        kind = rng.choice(["multipart/form-data; boundary=mark", 'Multipart/Form-Data; charset=x; boundary="mark"'])
        assert uploads.split_parts(kind, body_of(parts)) == parts


def test_bodies_of_another_writer():
    message = MIMEMultipart("form-data", boundary="b1")
    for i in range(3):
        part = MIMENonMultipart("image", "png")
        part.add_header("Content-Disposition", "form-data", name="files", filename=f"{i}.png")
        part.set_payload(f"content {i}\r\n--b0")
        message.attach(part)
    raw = message.as_bytes().replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").partition(b"\r\n\r\n")[2]
    assert [(p[0], p[1], p[3]) for p in uploads.split_parts("multipart/form-data; boundary=b1", raw)] == [("files", f"{i}.png", f"content {i}\r\n--b0".encode()) for i in range(3)]


def test_what_is_no_body():
    assert uploads.split_parts(None, b"x") == uploads.split_parts("image/png", PNG) == uploads.split_parts("multipart/form-data; boundary=m", None) == uploads.split_parts("multipart/form-data; boundary=m", b"no mark") == []


def test_refusals_of_scans(spark):
    cases = [("invalid.png", b"not an image", "image/png", 400, "Could not decode image file."), ("invalid.txt", b"not an image", "text/plain", 400, "File uploaded must be an image."), ("a.png", PNG, None, 400, "File uploaded must be an image."), ("a.png", PNG, "image/png", 200, None), ("b.png", PNG * 10, "image/png", 413, "Uploaded image is too large."), ("e.png", b"", "image/png", 400, "Could not decode image file.")]
    rows = [(i, "multipart/form-data; boundary=mark", body_of([("file", name, kind, content)])) for i, (name, content, kind, _, _) in enumerate(cases)]
    parts = uploads.read_parts(spark.createDataFrame(rows, "request_id long, content_type string, body binary"))
    got = {r["request_id"]: (r["status"], r["detail"]) for r in uploads.judge_scans(parts, most_bytes=100).collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_refusals_of_bursts(spark):
    burst = lambda *contents: body_of([("files", f"{i}.png", "image/png", c) for i, c in enumerate(contents)])
    rows = [(1, burst(PNG, b"", PNG)), (2, burst()), (3, burst(*[b"x"] * 4)), (4, burst(b"x", b"y" * 50)), (5, None)]
    requests = spark.createDataFrame([(i, "multipart/form-data; boundary=mark", b) for i, b in rows], "request_id long, content_type string, body binary")
    parts = uploads.read_parts(requests)
    verdicts = uploads.judge_bursts(requests, parts, most_bytes=40, most_frames=3)
    assert {r["request_id"]: (r["status"], r["n_files"], r["n_frames"]) for r in verdicts.collect()} == {1: (200, 3, 2), 2: (400, 0, 0), 3: (413, 4, 4), 4: (413, 2, 2), 5: (400, 0, 0)}
    assert sorted((r["request_id"], r["frame_no"], bytes(r["content"])) for r in uploads.frames_of(parts, verdicts).collect()) == [(1, 0, PNG), (1, 2, PNG)]
