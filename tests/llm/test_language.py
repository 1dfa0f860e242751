import zlib
from collections import Counter

from carelens.llm import language

SIZE = language.PROFILE


def grams(text):
    out, word = Counter(), []
    s = [c if c.isalpha() else " " for c in text.lower()]
    for w in "".join(s).split():
        word.append(w)
        out.update(w)
    joined = " " + " ".join(word) + " " if word else ""
    for n in (2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i:i + n]
            if " " not in g[1:-1] and g != "  ":
                out[g] += 1
    return out


def code(g):
    return sum((1 if c == " " else ord(c)) << (21 * i) for i, c in enumerate(g))


def rank(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:SIZE]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_like_brute_force(spark, frame, docs_rows, edge_rows):
    rows = docs_rows + [r for r in edge_rows if r[0] not in (None, 7, 8, 10)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    learn = {}
    for i, t, lang, *_ in rows:
        if not held(i) and t is not None and lang is not None:
            learn.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: {g: r for r, g in enumerate(rank(c))} for k, c in learn.items()}
    got = {r["doc_id"]: r for r in language.languages(spark, frame(rows)).collect()}
    assert len(got) == len(rows)
    right = total = 0
    for i, t, lang, *_ in rows:
        r = got[i]
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1
        own = rank(grams(t or ""))
        if not own:
            assert r["lang_pred"] == "und"
            continue
        cost = {k: sum(abs(p[g] - j) if g in p else SIZE for j, g in enumerate(own)) for k, p in profiles.items()}
        assert r["lang_pred"] == min(sorted(cost), key=cost.get)
        assert abs(r["score"] - (1 - min(cost.values()) / (SIZE * len(own)))) < 1e-12
        if r["held_out"] and lang:
            total += 1
            right += r["lang_pred"] == lang
    assert right / total > 0.95


def test_edges(spark, frame, edge_rows):
    got = [r["lang_pred"] for r in language.languages(spark, frame([(i, None, None, None, None) for i in range(9)])).collect()]
    assert got == ["und"] * 9
    assert language.languages(spark, frame([])).count() == 0
    rows = language.languages(spark, frame(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "the quick brown fox, jumps over the lazy dog. " * 40
    whole = [x.tolist() for x in language.ngram_counts(text)]
    monkeypatch.setattr(language, "PART", 50)
    assert [x.tolist() for x in language.ngram_counts(text)] == whole
