import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.llm import spelling


def by_hand_counts(rows, every):
    held = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode()) & 0xFFFFFFFF
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                held[run] += 1
    return {w: n for w, n in held.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(counts, times=10):
    words = sorted(counts)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def result(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_words_of_documents(spark, frame, docs_rows, edge_rows):
    rows = docs_rows + edge_rows
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame(rows), damage_every=31).collect()}
    assert got == by_hand_counts(rows, 31)
    plain = {r["word"]: r["n"] for r in spelling.word_counts(frame(rows)).collect()}
    assert plain == by_hand_counts(rows, 1 << 40)
    assert spelling.word_counts(frame([])).count() == 0


def test_groups_by_brute_force(spark, frame, docs_rows):
    """Few letters, many near words and long chains; accents, repeated bigrams; real words too."""
    draw = random.Random(5)
    counts = by_hand_counts(docs_rows, 31)
    counts = dict(sorted(counts.items())[:700])
    for alphabet, size in (("ab", 150), ("abcé", 300), ("eèÀn", 200)):
        for _ in range(size):
            w = "".join(draw.choice(alphabet) for _ in range(draw.randint(7, 11)))
            counts[w] = 10 ** draw.randint(1, 7) + draw.randint(0, 3)
    counts["aaaaaaa"], counts["aaaaaaaa"], counts["aaaaaaaaa"] = 2, 20, 200
    words = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 AS near", "'x' AS form")
    got = result(spelling.variant_groups(spark, words.select("word", "n")))
    assert len(got) == len(counts) and set(got) == by_hand(counts)


def test_ties_and_chains(spark):
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefgy": 20, "abcdefxy": 200, "abcdexxy": 2000, "unrelated": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r[0]: r for r in result(spelling.variant_groups(spark, words))}
    assert got["abcdefgh"] == ("abcdefgh", "abcdefgx", "abcdefgx", 2, 2, 20)
    assert got["abcdefgy"][1:3] == ("abcdefxy", "abcdexxy")
    assert got["unrelated"] == ("unrelated", None, "unrelated", 5, 0, None)
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(spark, empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=6, max_size=14))
def test_pivots_do_not_overlap_and_cost_least(grams):
    rank = np.asarray([grams])
    share = np.log((rank + 1) / 500)
    last, left, right, inside = spelling.choose_pivots(rank, share)
    assert inside[0].sum() >= spelling.PREFIX and inside[0, left[0]] and inside[0, right[0]] and right[0] - left[0] >= 2
    assert last[0] == sorted(grams)[spelling.PREFIX - 1]

    def cost(p, q):
        return np.exp(share[0, p + 2:].sum() / 2) + np.exp(share[0, :q - 1].sum() / 2)

    places = np.flatnonzero(inside[0])
    least = min(cost(p, q) for p in places for q in places if q - p >= 2)
    assert np.isclose(cost(left[0], right[0]), least)
