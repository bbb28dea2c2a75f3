"""The pipeline, stage by stage and as a whole, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from attestor.llm import decontaminate
from attestor.llm.byte_bpe import vocabulary_path
from attestor.llm.common import LOWER


def near(a, b):
    """Whether two strings are one edit apart at most: what is left between the common beginning and end has a character at most."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1


def lines(docs):
    seen, out = [], []
    for d, t in sorted(docs, key=lambda x: x[0]):
        kept = []
        for s in t.split("\n"):
            if not s.strip() or not any(s == o or min(len(s), len(o)) >= 16 and abs(len(s) - len(o)) < 2 and near(s, o) for o in seen):
                kept.append(s)
            if s.strip():
                seen.append(s)
        out.append((d, "\n".join(kept)))
    return out


def first_of_groups(docs):
    sets = []
    for _, t in docs:
        w = t.encode().translate(LOWER).split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [docs[i] for i in range(len(docs)) if find(i) == i]


def uncontaminated(docs, items):
    cut = lambda t: t.encode().translate(decontaminate.WORDS).split()
    windows = set()
    for t in items:
        w = cut(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for d, t in docs:
        w, hit = cut(t), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not hit or 20 * len(hit) < len(w):
            out.append((d, t))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    parts = {"aa": ["th", "er", "ing", "and", "on", "re"], "bb": ["ich", "ung", "ver", "sch", "ö", "nd"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    text = lambda lang: "\n".join(" ".join(word(lang) for _ in range(10)) for _ in range(6))
    items = [" ".join(word("aa") for _ in range(n)) for n in (20, 30, 6)]
    docs = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 85)]
    docs += [(200 + i, t.replace(" ", " x ", 1), lang) for i, (_, t, lang) in enumerate(docs[:10])]  # lines that nearly repeat
    docs += [(300 + i, text("aa") + " " + items[i % 3] + " " + word("aa"), "aa") for i in range(6)]
    docs += [(400, text("aa"), None), (401, "Съешь же ещё этих мягких французских булок. " * 12, None), (402, "0f9a 77c1 " * 200, "aa"), (403, None, "aa"), (404, "", None)]
    once = text("aa").replace("\n", " ")
    docs += [(500, once, "aa"), (501, once + " " + word("aa"), "aa"), (502, once.upper(), "aa")]
    return docs, items


def test_run_equals_brute_force(spark, corpus, tmp_path):
    docs, items = corpus
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in docs], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    stage = spark.read.parquet(f"{sf}/documents.parquet")
    want = [(d, t) for d, t, _ in docs if d not in (401, 402, 403, 404)]
    brute = [lambda x: x, lines, first_of_groups, lambda x: uncontaminated(x, items)]
    sizes = []
    for (name, run), expected in zip(corpus_pipeline.STAGES, brute):
        got = corpus_pipeline.written(run(spark, stage, sf))
        want = expected(want)
        assert got.columns == stage.columns, name
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(want), name
        sizes.append(len(want))
        stage = got
    assert sizes[0] < len(docs) and sizes[1] == sizes[0] > sizes[2] > sizes[3]
    assert {r["doc_id"]: r["lang"] for r in stage.collect()}[400] == "aa"
    library = Tokenizer.from_file(vocabulary_path())
    digest = lambda t: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == sorted((d, digest(t)) for d, t in want)
