"""The ten operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import ann, bpe, components, decontaminate, langid, line_dedup, simhash, token_counts, token_files, url_filter
from attestor.llm.byte_bpe import vocabulary_path
from attestor.llm.common import LOWER

PATH = vocabulary_path()
ODD = [
    None, "", " ", "\n\n", "a  b", "a   b\n\n c", "it's 's  't ''s \t's 'LL I'll", "<|endoftext|> a<|endoftext|>", "日本語 テキスト　x", "🎉 ‍ x", "1234½ Ⅷ", "a\n b\n  c \n", "é" * 60,
    "x" * 3000 + " y", "aaaa" * 700, "the cat sat " * 900, "the cat sat " * 900,
]
#: Other columns of the input, whose names the operators use themselves.
CLASH = ", fp long, id string, block long, part int, row string, n_tokens int, doc long"


def documents(spark, texts, first=0):
    rows = [(first + i, t, 7, "x", 1, 2, "r", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + CLASH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def sample(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()] + ODD


def test_bpe_round_trip(spark, library, sample):
    docs = documents(spark, sample)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(sample):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    again = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert again == {i: t or "" for i, t in enumerate(sample)}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_token_counts(spark, library, sample):
    rng = random.Random(3)
    texts = sample + ["".join(rng.choice(["'", "s", "t", "re", " ", "\n", "1", "a", "-", "é", "ll"]) for _ in range(25)) for _ in range(200)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(documents(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_scan_composes_maps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        constant, entry, exits = rng.random(37) < 0.3, rng.integers(0, 2, 37), rng.integers(0, 2, 37)
        constant[0] = True
        known, states = token_counts.scan(constant, entry, exits)
        last = None
        for i in range(37):
            last = int(exits[i]) if constant[i] or last == entry[i] else None
            assert bool(known[i]) == (last is not None) and (last is None or states[i] == last)


def test_token_counts_of_long_pieces(library, monkeypatch):
    rng = random.Random(9)
    texts = ["x" * 40_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "".join(rng.choice("日本語のテキストを書く") for _ in range(30_000)), "ab" * 20_000 + " c", "é1" * 9000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_slice(PATH, data, at).tolist() == want
    monkeypatch.setattr(token_counts, "MOST_STATES", 60)
    token_counts.transducer(PATH).clear()
    assert token_counts.count_slice(PATH, data, at).tolist() == want


def test_token_files(spark, library, sample, tmp_path):
    docs = documents(spark, sample, 5).unionByName(documents(spark, ["again"], 5)).unionByName(documents(spark, ["none"]).withColumn("doc_id", F.lit(None).cast("long")))
    where = f"file://{tmp_path}/shards"
    manifest = token_files.write(docs, PATH, where, 2)
    rows = token_files.read(manifest, where).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 5, 5, *range(6, 5 + len(sample))]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    for r in rows[3:]:
        ids = [*library.encode(sample[r["doc_id"] - 5] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    shard = token_files.read_shard(where, manifest.orderBy("name").first()["name"])
    assert len(shard.get(5)) == 2 and shard.get(10**9) == []
    assert token_files.write_and_read(docs.limit(0), PATH).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(2).choice(2**62, 5000, replace=False).astype(np.uint64)
    index = token_files.PerfectHash.build(keys)
    assert sorted(index.lookup(keys).tolist()) == list(range(5000))


def words(t):
    return (t or "").encode().translate(LOWER).split()


def fingerprint(t):
    w = words(t)
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(n, pairs):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_simhash(spark, sample):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["of", "the", "red", "cat", "sun", "ran", "far", "now"]) + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(12)]
    texts = sample + base + [b.replace(b.split()[k], "edit", 1) for b in base for k in (7, 9)]
    fps = [fingerprint(t) for t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", w) for i, (f, w) in enumerate(zip(fps, want))}
    assert {r["doc_id"] for r in simhash.keep_first(documents(spark, texts)).collect()} == set(want)
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("fine", [0, 10**12])
def test_simhash_tiles(fine, monkeypatch):
    monkeypatch.setattr(simhash, "FINE", fine)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    x = np.unique(np.concatenate([x] + [x ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(5)]))
    place = {v: i for i, v in enumerate(x.tolist())}
    want = groups(len(x), np.argwhere(np.bitwise_count(x[:, None] ^ x) <= 4).tolist())
    a, b = x[::2], x[1::2]
    edges = [simhash.compare(a, None, 4), simhash.compare(b, None, 4), simhash.compare(a, b, 4)]
    assert groups(len(x), [(place[p], place[q]) for u, v in edges for p, q in zip(u.tolist(), v.tolist())]) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 130)}


def test_decontaminate(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x1"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([5, 13, 14, 30, 1, 60, 0])] + [(20, None), (21, "!!"), (22, "w1, W2! w3")]
    texts = [None, "", "??", *(item(n) for n in (3, 50, 200)), item(40) + " " + items[3][1].upper().replace(" ", ", ") + " " + item(400), items[5][1], items[0][1] + ". " + item(20), items[5][1][:90], items[5][1]]
    cut = lambda t: (t or "").encode().translate(decontaminate.WORDS).split()
    got = {r["doc_id"]: r for r in decontaminate.matches(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in enumerate(texts):
        w, hit, names = cut(t), set(), set()
        for i, it in items:
            x = cut(it)
            size = min(13, len(x))
            for p in range(len(x) - size + 1) if x else ():
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == x[p : p + size]:
                        hit |= set(range(q, q + size))
                        names.add(str(i))
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == (len(w), len(hit), sorted(names))
    assert got[7]["longest"] == 60 and got[7]["longest_at"] == 0
    kept = {r["doc_id"] for r in decontaminate.remove(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d in got if not (got[d]["n_hit"] and 20 * got[d]["n_hit"] >= got[d]["n_words"])}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark):
    base = ["the quick brown fox jumps over", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdef", "short", "é" * 20 + "ü" * 9, "The Quick brown fox jumps over"]
    edited = [b[:k] + m + b[k + d :] for b in base for k in (0, 7, len(b) - 1) for m, d in (("X", 1), ("", 1), ("Y", 0))]
    texts = [None, "", "\n", "\n".join(base), "\n".join(edited[:30]), "short\n  \n" + base[0], "\n".join([*edited[30:], *base]), "new line that is long enough", "new line that is long enough"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.dedup_lines(docs).collect()}
    seen = []
    for d, t in enumerate(texts):
        lines, kept = [] if t is None else t.split("\n"), []
        for s in lines:
            if not s.strip():
                kept.append(s)
                continue
            if not any(s == o or min(len(s), len(o)) >= 16 and edits(s, o) <= 1 for o in seen):
                kept.append(s)
            seen.append(s)
        assert got[d] == (None if t is None else "\n".join(kept), len(lines), len(kept)), d
    assert set(docs.columns) < set(line_dedup.dedup_lines(docs).columns)


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    model = langid.fit(docs)
    odd = {r["doc_id"]: r for r in langid.predict(documents(spark, [None, "", "12 34!", "é", "of the and"]), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(odd[i]["rejected"] for i in range(3)) and odd[4]["lang_pred"] == "en"
    assert langid.predict(docs.limit(5).select("doc_id", "text"), langid.fit(docs.limit(0))).where("lang_pred != 'und'").count() == 0


def test_url_filter(spark):
    rules = url_filter.rule_table(spark, [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("ample.com", "/", "block")])
    urls = ["http://www.example.com/en/75", "https://com/en/", "http://x.com/en", "HTTP://EXAMPLE.com/en/8?q", "http://example.com?/en/7", None, "no scheme", "http://sample.com/", "http://example.com/en/7", "http://example.com/en/7", "://"]
    rows = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id long, url string, part int, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows, rules).collect()}
    assert got[0] == ("www.example.com", "/en/75", "example.com/en/7", "allow") and got[1] == ("com", "/en/", "com/en/", "block") and got[2][2] is None
    assert got[3] == ("example.com", "/en/8", "com/en/", "block") and got[4] == ("example.com", "", None, "allow") and got[5] == got[6] == got[10] == ("", "", None, "allow")
    assert got[7][2] is None and got[8] == got[9] and len(got) == len(urls)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v[400:450] = v[3]
    rows = [(i, [float(x) for x in r], "t", 1) for i, r in enumerate(v)]
    bad = [(1000, None, "", 0), (1020, [0.0] * 16, "", 0), (1040, [float("nan")] * 16, "", 0), (1060, [1.0, None] * 8, "", 0), (1080, [1.0], "", 0), (None, [1.0] * 16, "", 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, g string, ask int")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).toPandas()
    hits = 0
    for q, got in found.groupby("query_id"):
        score = v @ v[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:5]
        got = got.sort_values("rank")
        hits += len(set(want) & set(got["vec_id"]))
        assert list(got["rank"]) == [1, 2, 3, 4, 5] and np.allclose(got["score"], score[got["vec_id"]], atol=1e-12)
        assert list(zip(-got["score"], got["vec_id"])) == sorted(zip(-got["score"], got["vec_id"]))
    assert found["query_id"].nunique() == 30 and hits >= 0.9 * 150
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_neighbours():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    order = cells[np.argsort(ann.hilbert(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_pipeline_drops_near_copies(spark, sample):
    import corpus_pipeline

    rng = random.Random(11)
    base = [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(240)) for _ in range(30)]

    def edited(text, edits):
        out = text.split()
        for k in rng.sample(range(len(out)), edits):
            out[k] = f"edit{rng.randint(0, 10**6)}"
        return " ".join(out)

    texts = sample + base + [edited(b, k) for b in base for k in (1, 3, 4, 5, 6, 9, 15)]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    similar = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    want = set(groups(len(texts), pairs))
    assert len(texts) - len(want) > 60
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, documents(spark, texts), "").collect()} == want
