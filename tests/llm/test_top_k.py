import math

import numpy as np

from carelens.llm import top_k


def brute(rows, k=5):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in e]
        v[i] = max(v.get(i, x), x)
    out = {}
    for q, x in v.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v.items() if i != q and len(y) == len(x))
            for r, (neg, i) in enumerate(s[:k]):
                out[(q, r + 1)] = (i, min(-neg, 2 ** 63 - 1))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS sq")
    got = top_k.top_inner_products(spark, df, "vec_id % 50 = 0", 5, **kw).collect()
    assert len({(r["query_id"], r["rank"]) for r in got}) == len(got)
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}


def test_like_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 16)) * rng.lognormal(0, 1, (600, 1)) * np.linspace(3, 0.05, 16)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(m)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # ties, queries among them
    assert run(spark, rows, query_block=7, vector_block=50, tile=2) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0]), (6, []), (150, []), (7, [3e18, 1.0]), (8, [-0.001, 0.5]),
            (8, [-0.001, 0.5]), (None, [1.0, 1.0]), (200, [1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_repeated_ids_like_the_sql(spark):
    """All rows of an id are searched, as the registered SQL does; equal rows are left out here."""
    import duckdb

    from carelens.llm.queries import ORACLE
    rng = np.random.default_rng(5)
    rows = [(50, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [2.0, 0.5]), (2, [0.5, 0.5]), (2, [3.0, 0.0]), (50, [-1.0, 4.0])]
    rows += [(int(i), [float(c) for c in rng.normal(size=2)]) for i in rng.integers(0, 120, 300)]
    import pandas as pd
    embeddings = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [np.asarray(r[1], np.float32) for r in rows]})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = sorted((q, k, s) for q, k, _, s in con.execute(ORACLE["op2_top_k"]).fetchall())
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in e]) for i, e in rows], "vec_id long, embedding array<float>")
    got = top_k.top_inner_products(spark, df, "vec_id % 50 = 0", 5, query_block=3, vector_block=20).collect()
    assert sorted((r["query_id"], r["rank"], r["score"]) for r in got) == want
