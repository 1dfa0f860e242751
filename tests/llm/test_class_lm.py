import math
import zlib
from collections import Counter

import numpy as np
import pytest

from carelens.llm import class_lm as L


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def words(t):
    return (t or "").encode().lower().split()


def brute_base(rows):
    c = Counter()
    for i, t, *_ in rows:
        if i is not None and not held(i):
            c.update(words(t))
            c[L.END] += 1
    total, distinct = sum(c.values()), len(c)
    out = {}
    for i, t, *_ in rows:
        w = [*words(t), L.END]
        out[i] = (len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w))
    return out, c


@pytest.mark.parametrize("settings", [{}, {"dictionary": 300, "class_words": 40, "classes": 6}])
def test_base_like_brute_force(spark, frame, docs_rows, edge_rows, settings):
    rows = docs_rows + [(1000 + k, *r[1:]) for k, r in enumerate(edge_rows)]
    want, _ = brute_base(rows)
    got = {r["doc_id"]: r for r in L.lm_scores(spark, frame(rows), **settings).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_classes_beat_the_baseline(spark, frame, docs_rows):
    got = [r for r in L.lm_scores(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_probabilities_sum_to_at_most_one():
    """Over the dictionary, any other learned word, and one unseen word after any class."""
    rng = np.random.default_rng(1)
    vocabulary = [b"w%d" % i for i in range(12)]
    bigrams = rng.integers(0, 9, (14, 14)).astype(float)
    frequent = [(w, int(n)) for w, n in zip(vocabulary, rng.integers(5, 50, 12))] + [(b"o1", 4), (b"o2", 3), (L.END, 11)]
    rest = 5  # words with count 1 outside the dictionary
    total, distinct = sum(n for _, n in frequent) + rest, len(frequent) + rest
    m = L.ClassModel(frequent, total, distinct, vocabulary, bigrams, 4)
    for before in range(m.end + 1):
        p = sum(10 ** (m.transition[before, m.cls[i]] + m.emission[i]) for i in m.index.values())
        p += 10 ** (m.transition[before, m.end]) + (rest * 2 + 1) * 10 ** (m.transition[before, m.open] - m.open_base)
        assert p == pytest.approx(1.0, abs=1e-9)


def test_exchange_raises_likelihood_and_finds_classes():
    """Words that follow a strict class pattern end in their classes."""
    rng = np.random.default_rng(0)
    n = 12
    truth = np.arange(n) % 3
    bigrams = np.zeros((n + 2, n + 2))
    for a in range(n):
        for b in range(n):
            bigrams[a, b] = rng.integers(20, 30) if truth[b] == (truth[a] + 1) % 3 else 0
    start = rng.permutation(n)
    got = L.exchange_clustering(bigrams[np.ix_([*start, n, n + 1], [*start, n, n + 1])], 3)
    of = {w: int(k) for w, k in zip(start, got)}
    assert len({(truth[w], k) for w, k in of.items()}) == 3


def test_edges(spark, frame):
    assert L.lm_scores(spark, frame([])).count() == 0
    r = L.lm_scores(spark, frame([(None, "a b", "en", "s", 1)])).collect()[0]
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (False, 3, 0, 0, 0.0)


def test_words_beyond_the_seeds_get_classes(spark, frame):
    """Both halves of a strict alternation, in the dictionary or outside it, separate into the seeds' classes."""
    left, right = [b"l%d" % i for i in range(30)], [b"r%d" % i for i in range(30)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        pick = np.minimum(rng.geometric(0.2, 40) - 1, 29)
        rows.append((i, " ".join(f"l{a} r{b}" for a, b in zip(pick[::2], pick[1::2])), "en", "s", 1))
    model, rare, coded = L.learned(spark, frame(rows), 7, 2, dictionary=40, class_words=6, classes=4)
    of = {w: int(model.cls[i]) for w, i in model.index.items()}
    assert model.seeds == 6 < len(of)
    more = {bytes(r["word"]): (r["n"], r["cls"]) for r in rare.collect()}
    learned = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    assert {w: n for w, (n, _) in more.items()} == {w: n for w, n in learned.items() if w not in of}
    of |= {w: k for w, (n, k) in more.items() if n >= L.LEAST}
    assert sum(n >= L.LEAST for n, _ in more.values()) > 2 and set(of) == {w for w, n in learned.items() if w in model.index or n >= L.LEAST}
    assert not {of[w] for w in left if w in of} & {of[w] for w in right if w in of}
    assert all(k != model.open for k in of.values())
