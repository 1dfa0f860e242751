import random
import string

import numpy as np
import pytest

from carelens.llm import components as C
from carelens.llm import near_dups as N

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k=5):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return {(r[0], len(sets[i]), least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows)}


def got(spark, docs, **kw):
    rows = N.near_duplicates(spark, docs, **kw).collect()
    return len(rows), {tuple(r) for r in rows if r["doc_id"] is not None}


def copies(n, seed=0, words=120, edits=9):
    """Copies of one text with 0 to ``edits`` words changed."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_documents_and_edges(spark, frame, docs_rows, edge_rows):
    rows = docs_rows + [((1000 + r[0]) if r[0] is not None else None, *r[1:]) for r in edge_rows]
    rows += [(3000 + i, t, "en", "s", 1) for i, t in enumerate(copies(60))]
    rows += [(4000 + i, t.upper(), "en", "s", 1) for i, t in enumerate(copies(60, edits=3))]
    n, found = got(spark, frame(rows))
    assert n == len(rows) and found == brute(rows)


def test_large_clusters_are_dealt_into_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 20)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(copies(150, seed=4, edits=12) + copies(80, seed=5, edits=3))]
    n, found = got(spark, frame(rows))
    assert n == len(rows) and found == brute(rows)
    assert 3 < len({c for _, _, c, _ in found}) < 200


def test_empty(spark, frame):
    assert N.near_duplicates(spark, frame([])).count() == 0
    assert got(spark, frame([(1, None, "en", "s", 1), (2, "", "en", "s", 1)]))[1] == {(1, 0, 1, True), (2, 0, 2, True)}


def test_signature_is_circulant_and_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 800).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[:600], rng.integers(0, 1 << 63, 200).astype(np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    k = 2048
    assert abs((N.signature(a, k) == N.signature(b, k)).mean() - true) < 0.05
    assert np.array_equal(N.signature(a, 256), N.signature(a, k)[:256])


def test_shared_counts_like_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    want = [[len(np.intersect1d(x, y)) for y in sets[:25]] for x in sets]
    for width in (7, 4096):
        assert np.array_equal(N.shared_counts(sets, sets[:25], width), want)


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    if shape == "chain":
        edges = [(i, i + 1) for i in range(60)] + [(100, 99)]
    elif shape == "star":
        edges = [(7, i) for i in range(50)] + [(60, 61), (61, 60), (62, 62)]
    else:
        edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    got_roots = {r["node"]: r["root"] for r in C.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got_roots == {n: r for n, r in least.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_no_components(spark):
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
