import hashlib
import string
from collections import defaultdict

import pytest

from carelens.llm import exact_dedup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(FOLD)].append(r[0])
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 64])
def test_like_brute_force(spark, frame, docs_rows, edge_rows, bits):
    """With 64 bits nearly every row is a false alarm; results stay the same."""
    rows = docs_rows + [(1000 + (r[0] or 0), *r[1:]) for r in edge_rows] + [(2000 + i, "Hot copy É", "en", "s", 1) for i in range(400)] + [
        (2500, "HOT COPY É", "en", "s", 1), (2501, "hot copy é", "en", "s", 1)]
    got = sorted(map(tuple, exact_dedup.exact_groups(frame(rows), bits).collect()), key=str)
    assert got == brute(rows)


def test_survivors(spark, frame, edge_rows):
    docs = frame(edge_rows)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    texts = [(r["text"] or "").translate(FOLD) for r in kept.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(FOLD) for r in edge_rows})
    assert {r["doc_id"] for r in kept.collect() if r["text"] and r["text"].lower().startswith("same")} == {4}


def test_empty(spark, frame):
    assert exact_dedup.exact_groups(frame([])).count() == 0
    assert exact_dedup.without_copies(frame([])).count() == 0


def test_no_python(spark, frame, docs_rows):
    plan = exact_dedup.exact_groups(frame(docs_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
