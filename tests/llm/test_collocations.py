import random
import re
from collections import Counter, defaultdict

import pytest

from carelens.llm import collocations as C


def by_hand(rows, top):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        covered = set()
        for p, a in candidates.items():
            if len(p) == 3:
                covered |= {q for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        rows_ = []
        for p, a in candidates.items():
            if p in covered:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for i, (s, a, _, p, l, r) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p, -a, l, r, n[lang], -s))
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows(docs_rows):
    """Texts with many repeated phrases, ties, overlaps, several languages and strange characters."""
    draw = random.Random(3)
    out = list(docs_rows)
    for i in range(260):
        words = [draw.choice(["alpha", "Beta", "gamma", "ünï", "new york", "new york city", "a", "b", "a a a", "x.y", "q", "r\ts", "t\x0bu", "v\xa0w"])
                 for _ in range(draw.randint(0, 40))]
        words += [f"t{draw.randint(0, 40)}" for _ in range(30)]
        out.append((10_000 + i, " ".join(words) + draw.choice([".", "", "!\n"]), draw.choice(["en", "de", None, "xx"]), None, None))
    return out


def test_by_brute_force(spark, frame, rows, edge_rows):
    everything = rows + [(None, None, None, None, None), (1, "", "en", None, None)] + edge_rows[:7]
    docs = frame(everything, extra=False).selectExpr("*", "'x' AS h1", "'y' AS phrase", "1 AS rank")
    assert result(C.collocations(spark, docs)) == by_hand(everything, C.TOP)


def test_many_rounds(spark, frame, rows):
    """A first block of three phrases has to be followed by further ones."""
    assert result(C.collocations(spark, frame(rows, extra=False), top=40, first_rank=3)) == by_hand(rows, 40)


def test_small_filters_and_hash_collisions(spark, frame, rows, monkeypatch):
    """With a filter that lets nearly all through and hashes that clash under the first seeds, results are the same."""
    real = C.word_hash
    size = C.filter_of.__defaults__
    monkeypatch.setattr(C.filter_of, "__defaults__", (1 << 10,))
    some = rows[-260:]
    calls = []

    def saved(spark_, df, name, _saved=C.saved):
        calls.append(name)
        if name == "vocabulary" and calls.count(name) == 1:  # as if two words shared a hash
            df = df.selectExpr("lang", "word", "h & 15 AS h", "n")
        return _saved(spark_, df, name)

    monkeypatch.setattr(C, "saved", saved)
    assert result(C.collocations(spark, frame(some, extra=False), top=50)) == by_hand(some, 50)
    assert calls.count("vocabulary") == 2 and real("a", "b", 0) != real("a", "b", 1) and size


def test_empty_and_rare(spark, frame):
    assert result(C.collocations(spark, frame([], extra=False))) == []
    assert result(C.collocations(spark, frame([(1, "one two three " * 9, "en", None, None)], extra=False))) == []
    ten = [(1, "one two three. " * 10, "en", None, None)]
    assert result(C.collocations(spark, frame(ten, extra=False))) == by_hand(ten, C.TOP) == [
        ("en", 1, "one two three", 10, 10, 10, 30, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_007, 9_123_456_789_012, 12_345_678_901_234
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"CAST({C.score_sql('a', 'l', 'r')} AS long) AS s")
    assert df.first()["s"] == 1_000_000 * a * a // (l * r)
