import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.llm import toxicity as T


def ruzzo_tompa(scores):
    """All maximal scoring segments by definition: split at the best segment, left and right."""
    if not len(scores):
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        s = 0.0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > best:
                best, at = s, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return ruzzo_tompa(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in ruzzo_tompa(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-40, 40).map(lambda i: i + 0.5 if i >= 0 else i - 0.37), max_size=25))
def test_segments_like_the_definition(scores):
    """Sums are made all distinct by powers of two below the scores, so no ties decide."""
    x = np.asarray([s + 2.0 ** -(10 + i) for i, s in enumerate(scores)])
    got = T.maximal_segments(x)
    want = ruzzo_tompa(x.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.toxicity(spark, docs, labels).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    truth = duckdb.sql(f"SELECT doc_id, max(toxic) AS toxic FROM '{sf}/labels.parquet' GROUP BY 1").df()
    m = got[got["held_out"]].merge(truth, on="doc_id")
    assert auc(m["score"].to_numpy(), m["toxic"].to_numpy()) > 0.9
    hit = m["predicted"] == 1
    assert (m["toxic"][hit] == 1).mean() > 0.95 and hit[m["toxic"] == 1].mean() > 0.8


def test_edges(spark, frame, edge_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = T.toxicity(spark, frame(edge_rows), labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.filter("false")
    assert {r["predicted"] for r in T.toxicity(spark, frame(edge_rows), none).collect()} == {0}
    assert T.toxicity(spark, frame([]), labels).count() == 0


def test_spans_and_filter(spark, frame):
    rows = [(i, "calm words stand here in a row " * 3 + ("you vile idiotfool " if i % 4 == 0 else "") + f"number{i}", "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = frame(rows)
    model = T.learned(spark, docs, labels)
    text = rows[8][1]
    spans = model.spans(text)
    assert spans and any("idiotfool" in text[a:b] for a, b, _ in spans) and model.spans(rows[1][1]) == []
    left = T.without_toxic(spark, docs, model)
    assert left.columns == docs.columns and {r["doc_id"] % 4 for r in left.collect()} == {1, 2, 3}


def test_labels_without_a_text_take_no_place_in_the_sample(spark, frame):
    docs = frame([(i, f"text {i}", "en", "s", 1) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    rows = T.labelled_sample(docs, labels, 10).collect()
    assert len(rows) == 10 and all(r["text"] == f"text {r['doc_id']}" and r["toxic"] == r["doc_id"] % 2 for r in rows)
