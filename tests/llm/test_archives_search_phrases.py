"""WARC archives, lexical search and collocations against brute force, with nulls, ties, repeats, empty tables and long texts."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from attestor.llm import collocations, lexical, warc
from attestor.llm.common import shared_dir

CLASH = ["key", "id", "digest", "size", "file", "place", "n", "rank", "score", "words", "seq", "a", "l", "r", "phrase", "item", "route", "payload"]


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in df.columns))


# ---------------------------------------------------------------- WARC


def expected_records(rows):
    groups = defaultdict(list)
    for i, (page, url, html) in enumerate(rows):
        groups[(html or "").encode()].append((page is None, page or 0, url is None, url or "", i))
    out = [None] * len(rows)
    for payload, members in groups.items():
        members.sort()
        first = rows[members[0][-1]][0]
        for k, m in enumerate(members):
            copy = len(payload) >= 100 and k > 0
            out[m[-1]] = (rows[m[-1]][0], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if copy else "response", first if copy else None)
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(4)
    bodies = ["", "x" * 99, "x" * 100, "é" * 50, "é" * 49 + "a", "<p>\r\n\r\nWARC/1.1\r\n</p>" * 9, "long " * 300_000, None, *("body %d " % i * 20 for i in range(9))]
    hosts = ["a.example.com", "B.example.com", "example.com", "example.com:80", "", "x y"]
    rows = [(i, rng.choice([None, "no scheme", f"http://{rng.choice(hosts)}/{rng.randint(0, 3)}?q=a b\n#f"]), rng.choice(bodies)) for i in rng.sample(range(10_000), 150)]
    rows += [rows[0], rows[0], (rows[1][0], "http://other/", rows[1][2]), (None, "http://n/", "n" * 200), (None, None, "n" * 200), (7, "http://n/", "n" * 200)]
    return rows + [(20_000 + i, "http://hot.example/", "hot " * 50) for i in range(1500)]


def test_archives_give_back_every_page(spark, page_rows, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)  # the one hot URL spans blocks and shards
    pages = clashing(spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(5))
    got = warc.write_and_read(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_records(page_rows)


def test_lookup_reads_only_what_is_asked(spark, page_rows):
    pages = spark.createDataFrame(page_rows, "page_id long, url string, html string")
    where = shared_dir(spark)
    captures = warc.write(pages, where)
    shards = warc.index(captures, where)
    assert shards.agg(F.sum("lines")).first()[0] == len(page_rows)
    wanted = {"http://hot.example/", "http://B.example.com/1?q=a b\n#f", "http://absent.example/"}
    keys = spark.createDataFrame([(u,) for u in wanted], "url string").select(warc.url_key(F.col("url")).alias("key"))
    found = warc.lookup(shards, where, keys)
    assert sorted(r["id"] for r in found.collect()) == sorted(str(p) for p, u, _ in page_rows if u in wanted)
    payloads = {r["id"]: r["payload"] for r in warc.read(found, where).where("record_type = 'response'").collect()}
    texts = {str(p): (h or "").encode() for p, _, h in page_rows}
    assert payloads and all(bytes(v) == texts[k] for k, v in payloads.items())


def test_archives_are_warc_files(spark):
    """A plain reader finds whole records, one after another, and revisits name the record they repeat."""
    where = shared_dir(spark)
    rows = [(i, f"http://e.com/{i}", "same " * 30 if i % 2 else f"own {i} " * 30) for i in range(20)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), where).count()
    store, base = fs.FileSystem.from_uri(where)
    ids, refers, kinds = set(), set(), Counter()
    for info in store.get_file_info(fs.FileSelector(base)):
        raw = gzip.decompress(store.open_input_stream(info.path, compression=None).read())
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(fields[b"Content-Length"])
            assert raw[n : n + 4] == b"\r\n\r\n"
            raw = raw[n + 4 :]
            kinds[fields[b"WARC-Type"]] += 1
            ids.add(fields[b"WARC-Record-ID"])
            refers.add(fields.get(b"WARC-Refers-To"))
    assert kinds[b"response"] == 11 and kinds[b"revisit"] == 9
    assert refers - {None} <= ids


def test_damaged_payloads_are_refused():
    member = warc.pack_record("response", "1", "u", hashlib.sha256(b"abc").hexdigest(), 3, b"abd", "d")
    with pytest.raises(ValueError):
        warc.unpack_record(member)


def test_no_pages(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_keys(spark):
    urls = ["http://B.Example.com/P?q#f", "no scheme/x", "http://", None, "http://a b/c\td"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("key"))
    assert [r[0] for r in df.collect()] == ["com,example,b)/P?q#f", "no%20scheme)/x", ")", "", "a%20b)/c%09d"]


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def expected_ranks(docs, items, most=10):
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, ws) for d, ws in split if ws]
    total, words = len(split), sum(len(ws) for _, ws in split)
    df = Counter(w for _, ws in split for w in set(ws))
    out = []
    for item, text in items:
        scored = []
        for d, ws in split:
            tf, m = Counter(ws), 10 + 90 * len(ws) * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(terms(text)) if tf[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def search_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)] + ["Öl", "日本", "X1", "the"]
    text = lambda n: " ".join("the" if rng.random() < 0.4 else rng.choice(words) for _ in range(n)) + rng.choice(["", "!", " , .", "\n"])
    docs = [(i, text(rng.randint(1, 60))) for i in rng.sample(range(9000), 400)]
    docs += [docs[0], docs[0], (None, "the w1 w2"), (None, "the w1 w2"), (9001, None), (9002, ""), (9003, " ,;"), (9004, text(150_000))] + [(10_000 + i, "w3 the THE w4") for i in range(300)]
    items = [(i, text(rng.randint(1, 20))) for i in range(20)] + [(3, "w3 the"), (3, "w3 the"), (None, "w5"), (30, None), (31, "absent"), (32, "..."), (33, "the"), (34, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("sizes", [(8 << 20, 16384, 16 << 20), (4000, 7, 200)])
def test_search_equals_brute_force(spark, search_rows, sizes, monkeypatch):
    """Also in slices of a few documents and in several blocks of items."""
    docs, items = search_rows
    for name, value in zip(("SLICE", "SLICE_ROWS", "BLOCK"), sizes):
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), clashing(spark.createDataFrame(items, "item_id long, text string")))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_ranks(docs, items)


def test_masks_are_shared_by_equal_documents_only():
    rng = np.random.default_rng(3)
    bits = rng.random((200, 300)) < 0.01
    bits[:, 100:200] = bits[:, :100]
    group, count = lexical.masks_of([np.flatnonzero(x) for x in bits], 300)
    masks = [x.tobytes() for x in bits.T]
    assert len(set(masks)) == count == len({(g, m) for g, m in zip(group.tolist(), masks)})


def test_few_masks_are_evaluated():
    """The search ends before masks that can't enter; scores beyond that are never made."""
    n = 5000
    lists = [np.arange(0, n, 500), np.arange(n)]
    row = {
        "ids": np.arange(n).tobytes(), "has_id": np.ones(n, bool).tobytes(), "lengths": np.full(n, 10).tobytes(), "terms": [0, 1], "df": [len(x) for x in lists],
        "docs": np.concatenate(lists).astype(np.int32).tobytes(), "tf": np.ones(n + 10, np.int32).tobytes(),
    }
    scores, docs = lexical.Slice(row, n, 10 * n).best(np.array([0, 1]), np.array([5000, 1]), 10, 1)
    assert sorted(docs.tolist()) == list(range(0, n, 500)) and len(set(scores.tolist())) == 1


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert len(lexical.search(docs, items).collect()) == 1
    with pytest.raises(TypeError):
        lexical.search(docs.withColumn("doc_id", F.lit("x")), items)


# ---------------------------------------------------------------- collocations


def expected_phrases(rows, most, least, share=80):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, 5):
                for p in range(len(ws) - n + 1):
                    count[lang][tuple(ws[p : p + n])] += 1
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        best = []
        for p, a in cand.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, k, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(5)
    words = ["the", "of", "Öl", "日本", "a-b", "x\x00y", *(f"w{i}" for i in range(12))]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "! "]) for _ in range(n))
    rows = [(text(rng.randint(0, 120)), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(200)]
    rows += [("of the best of the best of the best", "en")] * 300 + [(None, "en"), ("", None), (". , ;", "fr"), (text(30_000), "de")]
    return rows + [("new york city hall " + rng.choice(words), "en") for _ in range(40)]


@pytest.mark.parametrize("most,least,route,sample", [(2000, 30, 3_000_000, 512), (7, 5, 3_000_000, 1), (2000, 3, 500, 2)])
def test_phrases_equal_brute_force(spark, phrase_rows, most, least, route, sample, monkeypatch):
    """Also with so many routes that phrases of three words are hot."""
    monkeypatch.setattr(collocations, "ROUTE", route)
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    docs = clashing(spark.createDataFrame(phrase_rows, "text string, lang string").repartition(4))
    got = collocations.mine(docs, most, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected_phrases(phrase_rows, most, least)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    for size, least in ((1, 1), (2, 1), (500, 3), (4000, 30)):
        cols = rng.integers(1, 6, (4, size)) * np.cumprod(rng.random((4, size)) < 0.9, axis=0).astype(int)
        cols[0] = np.maximum(cols[0], 1)
        weight = rng.integers(1, 4, size)
        want = Counter()
        for col, w in zip(cols.T.tolist(), weight.tolist()):
            for d in range(1, 5):
                if col[d - 1] == 0:
                    break
                want[tuple(col[:d])] += w
        got = {}
        for d, at, f in collocations.frequent(cols, weight, least):
            for p, n in zip(at.tolist(), f.tolist()):
                assert tuple(cols[:d, p]) not in got
                got[tuple(cols[:d, p].tolist())] = n
        assert got == {p: n for p, n in want.items() if n >= least}


def test_wide_vocabularies_group_alike():
    rng = np.random.default_rng(2)
    cols = rng.integers(0, 3, (4, 1000))
    small, wide = collocations.grouped(cols, 3), collocations.grouped(cols, 1 << 20)
    assert all((a == b).all() for a, b in zip(small, wide))
    words = [b"x", b"y"]
    names, got, counts, depth = collocations.unpack(collocations.pack(words, small[0], small[1], np.ones(len(small[1]), np.int64)))
    table = [None, *names]
    assert [[table[w] for w in c] for c in got.T.tolist()] == [[([None] + words)[w] for w in c] for c in small[0].T.tolist()]
    assert counts.tolist() == small[1].tolist() and set(depth.tolist()) == {1}


def test_no_phrases(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
