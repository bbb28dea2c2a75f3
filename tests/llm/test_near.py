"""Near duplicates: SimHash proposes, sets decide."""

import random

import numpy as np

from attestor.llm import near
from attestor.llm.components import forest

SCHEMA = "doc_id long, text string, n long"


def tile(sets):
    order = np.argsort([len(s) for s in sets], kind="stable")
    keys = order.astype(np.int64) * 7 - 40
    return keys, np.array([len(sets[k]) for k in order], np.int32), np.stack([near.simhash(sets[k]) for k in order]), keys


def test_fingerprints_propose_all_pairs_at_the_similarity(monkeypatch):
    monkeypatch.setattr(near, "ROWS", 5)
    monkeypatch.setattr(near, "COLUMNS", 11)
    rng = np.random.default_rng(5)
    sets = []
    for n in [4, 5, 9, 20, 40, 90, 300] * 4:
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        cut = n // 9
        sets += [np.unique(base), np.unique(np.append(base, rng.integers(0, 1 << 64, n // 4, dtype=np.uint64))), np.unique(np.append(base[cut:], rng.integers(0, 1 << 64, cut, dtype=np.uint64)))]
    key = lambda i: i * 7 - 40
    want = {(key(j), key(i)) for i in range(len(sets)) for j in range(i) if near.alike(sets[i], sets[j], 0.8)}
    half = len(sets) // 2 + 1
    whole = tile(sets)
    a, b = (tuple(x[s] for x in whole) for s in (slice(0, half), slice(half, None)))
    for held in (1 << 20, 3):
        monkeypatch.setattr(near, "HELD", held)
        alone = {p for u, v in near.propose(whole, None, 0.8, True) for p in zip(u.tolist(), v.tolist())}
        split = {p for x, y in ((a, None), (b, None), (a, b)) for u, v in near.propose(x, y, 0.8, True) for p in zip(u.tolist(), v.tolist())}
        assert want <= alone == split and len(want) >= 2 * len(sets) // 3
        trees = [np.concatenate(x) for x in zip(*near.propose(whole, None, 0.8, False))]
        nodes, where = np.unique(np.concatenate(trees), return_inverse=True)
        tree = forest(where[: len(trees[0])], where[len(trees[0]) :], len(nodes))
        pairs = np.array(sorted(alone))
        full = forest(*np.searchsorted(nodes, pairs).T, len(nodes))
        assert (tree == full).all() and len(trees[0]) == len(nodes) - len(np.unique(full))


def test_groups_over_many_tiles_keep_their_first(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 9)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(40):  # near copies of one text, some of which are linked through others alone
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [word() for _ in range(60)]) for _ in range(20)]  # half of it is the same
    texts += ["", None, "a b", "A  b"]
    sets = [near.shingles((t or "").encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near.alike(sets[i], sets[j], 0.8) or len(sets[i]) == len(sets[j]) == 0:
                root = [root[j] if r == root[i] else r for r in root] if root[j] < root[i] else [root[i] if r == root[j] else r for r in root]
    kept = near.keep_first(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r["doc_id"] for r in kept} == set(root) and len(kept) == len(set(root)) < 40
