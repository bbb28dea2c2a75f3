"""Nulls, repeated ids, empty tables, long texts and clashing names, for all ten operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import ann, bpe, decontaminate, langid, line_dedup, lm_score, near, simhash, token_counts, token_files, url_filter
from attestor.llm.byte_bpe import vocabulary_path

PATH = vocabulary_path()
#: Columns that the operators add or use themselves.
CLASH = ["n_lines", "n_kept", "fp", "id", "block", "held", "h", "rank", "score", "lang_pred", "rejected", "held_out", "n_hit", "n_tokens", "start", "row", "keep", "entries", "least", "bands", "slice"]


def rows(spark, pairs):
    df = spark.createDataFrame(pairs, "doc_id long, text string, lang string" if len(pairs[0]) == 3 else "doc_id long, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in df.columns))


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(2)
    return "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "Öl", "日本", "x1"]) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(14_000))


@pytest.fixture(scope="module")
def odd(long_text):
    """Null and repeated ids, repeated rows, nulls, an empty and a long text (over 1 MB)."""
    assert len(long_text.encode()) > 1 << 20
    return [(None, "a b c"), (None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (1, "another text of one id"), (2, None), (3, ""), (4, long_text), (5, long_text), (6, " \t\n")]


def test_every_row_gets_its_result(spark, odd, long_text):
    docs = rows(spark, odd)
    library = Tokenizer.from_file(PATH)
    n_ids = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((d, n_ids(t)) for d, t in odd), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH).collect()), key=key) == want
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.round_trip(docs, PATH).collect()), key=key) == want
    assert sorted(((r["doc_id"], r["n_tokens"] - 1) for r in token_files.write_and_read(docs, PATH).collect()), key=key) == want
    got = {(r["doc_id"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH).collect()}
    assert got == {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in odd}
    for found in (
        simhash.near_duplicates(docs),
        lm_score.score(docs, langid.held_out("doc_id", 7, 2)),
        langid.evaluate(rows(spark, [(d, t, "en") for d, t in odd])),
        decontaminate.matches(docs, spark.createDataFrame([(1, "a b c"), (None, "b c"), (2, None)], "item_id long, text string")),
        line_dedup.dedup_lines(docs),
    ):
        assert sorted(r[0] is None for r in found.select("doc_id").collect()) == sorted(d is None for d, _ in odd)


def test_empty_tables(spark):
    docs = rows(spark, [(1, "a", "en")])
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert line_dedup.dedup_lines(none).count() == token_counts.count_tokens(none, PATH).count() == near.keep_first(none).count() == 0
    assert decontaminate.matches(none, items).count() == 0
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.matches(docs, items.limit(0)).collect()] == [(1, 0, [])]
    assert decontaminate.remove(docs, items.limit(0)).count() == 1
    model = langid.fit(docs)
    assert langid.predict(none, model).count() == langid.keep_known(none, model).count() == 0
    pages, rules = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), url_filter.rule_table(spark, [("com", "/", "block")])
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == ["allow"]
    assert [r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()] == ["block"]


def test_clashing_names_and_columns_stay(spark, odd):
    docs = rows(spark, odd)
    out = line_dedup.dedup_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns) and {r["n_lines"] for r in out.select("n_lines").collect()} > {0, 1}
    assert decontaminate.remove(docs, spark.createDataFrame([(1, "zz")], "item_id long, text string")).columns == docs.columns
    model = langid.fit(rows(spark, [(1, "some text here", "en")]))
    assert langid.keep_known(docs, model).columns == docs.columns


def test_one_row_of_each_group_stays(spark, odd):
    kept = near.keep_first(rows(spark, odd)).collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:22]) for r in kept) == [(1, "a b c"), (1, "another text of one id"), (2, ""), (4, odd[8][1][:22])]
    assert near.keep_first(rows(spark, odd[:2])).count() == 1


def test_rejection(spark):
    rng = random.Random(6)
    parts = {"aa": ["th", "er", "ing", "and", "on"], "bb": ["ich", "ung", "ver", "sch", "ö"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang: " ".join(word(lang) for _ in range(rng.randint(60, 120)))
    clean = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 120)]
    junk = ["Съешь же ещё этих мягких французских булок да выпей чаю. " * 8, " ".join("%04x" % rng.randrange(1 << 16) for _ in range(500)), " ".join("".join(rng.choice("bcdfgjklmpqvwxz") for _ in range(7)) for _ in range(60)), "吾輩は猫である。名前はまだ無い。" * 12]
    docs = rows(spark, clean + [(1000 + i, t, None) for i, t in enumerate(junk)] + [(2000, text("aa"), None), (3000, None, "aa"), (3001, "12 34", "aa")])
    model = langid.fit(docs)
    assert len(model.languages) > 2  # several centroids a language
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_known(docs, model, lang_col="lang").collect()}
    assert kept == {i: lang for i, _, lang in clean} | {2000: "aa"}


def test_keyed_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 64)
    texts = [f"text number {i} of the table" for i in range(60)]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)] + [(30, "again")], "doc_id long, text string")
    where = f"file://{tmp_path}/shards"
    manifest = token_files.write(docs, PATH, where, 2)
    assert manifest.count() > 8 and manifest.where("least > greatest").count() == 0
    library = Tokenizer.from_file(PATH)
    asked = spark.createDataFrame([(0,), (30,), (31,), (177,), (None,), (10**12,), (0,)], "doc_id long")
    got = sorted((r["doc_id"], r["ids"]) for r in token_files.lookup(manifest, where, asked).collect())
    assert got == sorted((d, [*library.encode(t, add_special_tokens=False).ids, 2]) for d, t in [(0, texts[0]), (30, texts[10]), (30, "again"), (177, texts[59])])
    with pytest.raises(TypeError):
        token_files.write(docs.withColumn("doc_id", F.lit("x")), PATH, where, 2)


def test_ties_at_the_cut(spark):
    v = np.eye(8)
    rows = [(i, v[0].tolist()) if i == 0 else (i, (v[0] + v[1 + i % 7]).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_nested_rules_of_any_number(spark):
    rng = random.Random(4)
    host = lambda n: ".".join(rng.choice(["com", "a", "b", "x-y", "ab", "0"]) for _ in range(n))
    path = lambda n: "".join(rng.choice("/ab.é") for _ in range(n))
    rules = list({(host(rng.randint(1, 3)), path(rng.randint(0, 4)), rng.choice(["allow", "block"])) for _ in range(200)})
    urls = [(i, host(rng.randint(1, 5)), "/" + path(rng.randint(0, 6))) for i in range(800)] + [(900 + i, "hot.a.com", f"/{i}") for i in range(400)]
    table = spark.createDataFrame([(i, f"http://{h.upper()}{p}?q") for i, h, p in urls], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(table, url_filter.rule_table(spark, rules)).collect()}
    for i, h, p in urls:
        fits = [(-len(a + b), -len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert got[i] == ((min(fits)[2], min(fits)[3]) if fits else (None, "allow"))
