"""Records of JSON files read in splits, against a plain reader, cut at every place where Spark may cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.sources import cards as sources
from attestor.sources import json_records as J

TRICKY = [
    {"id": 'a"}', "name": "{[\\", "set": {"id": "x", "printedTotal": 1}},
    {"id": "}", "name": "\\\\\"}]", "images": {"small": "é{日本}"}},
    {"id": "c", "list": [{"id": "no record"}, [], [[{}]]], "cards": [{"id": "nor this"}]},
    {},
    {"id": "line\nbreak}", "x": "\\u007d\\"},
]


def documents():
    """Texts with the array level that counts, and what a plain reader finds there."""
    wrapped = {"source": "s}", "sets": [{"id": "other"}], "generated_at": None, "cards": TRICKY, "after": [{"id": "other"}], "more": {"cards": [{"id": "deeper"}]}}
    for indent in (None, 2):
        yield json.dumps(TRICKY, indent=indent), "cards", TRICKY
        yield json.dumps(TRICKY, indent=indent), None, TRICKY
        yield json.dumps(wrapped, indent=indent, ensure_ascii=False), "cards", TRICKY
    yield json.dumps([1, None, "x", [], *TRICKY, 2.5]), None, TRICKY
    yield "\n".join(json.dumps(x) for x in TRICKY) + "\n", None, TRICKY
    yield "[]", None, []
    yield '{"cards": []}', "cards", []


def cut_and_joined(parts, within):
    """What the reader's steps give for a file that is cut into ``parts``."""
    state, open_, whole, pieces = (False, 0, ()), None, [], []
    for k, part in enumerate(parts):
        head, full, tail = J.records(part, state[0], state[2], within)
        if head is not None:
            pieces.append((open_, k, head))
        whole += [(k, i, x) for i, x in enumerate(full)]
        kept = len(state[2]) - J.summary(part, state[0])[1]
        state = J.compose(state, J.summary(part, state[0]))
        depth = next((d for d in range(len(state[2])) if J._at_level(state[2][:d], within) and state[2][d][0] == "{"), None)
        if depth is not None and kept <= depth:
            open_ = k
        if tail is not None:
            pieces.append((k, k, tail))
    joined = {}
    for began, k, piece in sorted(pieces):
        joined[began] = joined.get(began, b"") + piece
    whole += [(k, 1 << 40, x) for k, x in joined.items()]
    return [json.loads(x) for _, _, x in sorted(whole)]


def test_every_cut_gives_the_same_records():
    for text, within, want in documents():
        raw = text.encode()
        ends = [i + 1 for i, b in enumerate(raw) if b == 125]
        cuts = [[e] for e in ends] + [[a, b] for a in ends for b in ends if a < b] + [ends]
        for cut in cuts:
            places = sorted({0, *cut, len(raw)})
            parts = [raw[a:b] for a, b in zip(places, places[1:])]
            assert cut_and_joined(parts, within) == want, (text, cut)


def test_summaries_compose():
    rng = random.Random(2)
    raw = json.dumps({"cards": TRICKY * 3}).encode()
    for _ in range(200):
        a, b = sorted(rng.sample([i + 1 for i, c in enumerate(raw) if c == 125], 2))
        for start in (False, True):
            first = J.summary(raw[:a], start)
            assert J.compose(first, J.summary(raw[a:b], first[0])) == J.summary(raw[:b], start)


@pytest.mark.parametrize("size", ["300", "128m"])
def test_files_are_read_in_many_splits(spark, tmp_path, size):
    rng = random.Random(7)
    rows = [dict(rng.choice(TRICKY), id=f'{i}"}}{{', pad="}" * rng.randint(0, 40)) for i in range(90)]
    (tmp_path / "a.json").write_text(json.dumps({"note": "[{", "cards": rows[:60]}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[60:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = J.with_positions(J.read_records(spark, str(tmp_path), "cards"))
        got = [json.loads(r["body"]) for r in sorted(found.collect(), key=lambda r: r["position"])]
        starts = found.select("path", "start").distinct().count()
        cards = {r["id"]: r["name"] for r in sources.read_catalog(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == rows
    assert cards == {r["id"]: r.get("name") for r in rows}
    assert starts >= 2 if size == "128m" else starts > 20


def test_index_of_lines_keeps_all_rows(spark, tmp_path):
    rows = [{"card_id": c, "name": c, "embedding": [1.0, float(i)]} for i, c in enumerate("abc")]
    (tmp_path / "meta.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    spark.createDataFrame([(i, [9.0, float(i)]) for i in range(3)], "position int, embedding array<float>").write.parquet(str(tmp_path / "v"))
    read = lambda v: {r["card_id"]: list(r["embedding"]) for r in sources.read_index(spark, str(tmp_path / "meta.jsonl"), v).collect()}
    assert read(None) == {c: [1.0, float(i)] for i, c in enumerate("abc")}
    assert read(str(tmp_path / "v")) == {c: [9.0, float(i)] for i, c in enumerate("abc")}


def test_empty_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert J.read_records(spark, str(tmp_path / "empty.json")).select(F.count("*")).first()[0] == 0
    assert sources.read_catalog(spark, str(tmp_path / "absent.json")).count() == 0
