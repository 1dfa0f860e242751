"""Exact top-k inner products: vectors by falling length, SVD-rotated partial sums, pruning.

Vectors are quantised to integers, rotated by the singular vectors of the whole table (found
from its Gram matrix, which tasks sum up in parts), and grouped into blocks by falling length.
Query blocks meet vector blocks in tiles. Inside a tile the rotated vectors are multiplied slice
by slice; after each slice the Cauchy-Schwarz bound (partial sum plus the product of the two
residual lengths) drops vectors that cannot reach the query's k-th best score so far. What
survives is scored again in whole numbers, so results are exact. Each tile gives at most k rows
for a query; a last step keeps the best k.

Defined cases: vectors that are NULL or hold a NULL or non-finite component take no part, as
rows with a NULL id; vectors of different dimension are never compared; of equal scores the
smaller id ranks first; rows that repeat an id with different vectors are all searched (none is a
partner of its own id), equal rows count once; scores beyond 64 bits stop at its ends; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelens.llm.common import saved

SCALE = 256
EXACT = 2.0 ** 53


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of whole doubles floor(scale * component)), dim, squared length."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    whole = "x IS NOT NULL AND vec_id IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    v = v.filter(whole).select(
        "vec_id", F.expr(f"transform(x, c -> CAST(floor(CAST({scale} AS double) * c) AS double))").alias("x"))
    return v.withColumn("dim", F.size("x")).withColumn("sq", F.expr("aggregate(x, double(0), (a, c) -> a + c * c)"))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of the table (strongest first)."""
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                m = np.stack(part["x"].to_numpy()) if dim else np.zeros((len(part), 0))
                m = m / max(1.0, float(np.abs(m).max(initial=0)))
                sums[dim] = sums.get(dim, 0) + m.T @ m
        rows = [(d, i, r) for d, g in sums.items() for i, r in enumerate(g)]
        if rows:
            yield pd.DataFrame({"dim": [r[0] for r in rows], "i": [r[1] for r in rows], "row": [r[2] for r in rows]})

    parts = vectors.select("dim", "x").mapInPandas(gram, "dim int, i int, row array<double>")
    total = parts.select("dim", "i", F.posexplode("row").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for dim, part in total.toPandas().groupby("dim"):  # dim * dim numbers
        g = np.zeros((dim, dim))
        g[part["i"], part["j"]] = part["v"]
        out[int(dim)] = np.linalg.eigh(np.nan_to_num(g))[1][:, ::-1].copy()
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products in whole numbers of one query with rows of x."""
    if len(q) and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q) < EXACT:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(c) for c in q]
    limit = (1 << 63) - 1
    return [max(-limit - 1, min(limit, sum(a * int(b) for a, b in zip(whole, r)))) for r in x]


def block_top_k(q_ids, q, x_ids, x, rotation, k: int, slices: int = 4) -> tuple[list, list, list]:
    """(query id, vector id, score) of the k best rows of x for each query; x by falling length."""
    dim = q.shape[1]
    out_q: list[int] = []
    out_x: list[int] = []
    out_s: list[int] = []
    scale = max(1.0, float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
    qr, xr = (q / scale) @ rotation, (x / scale) @ rotation
    cuts = np.linspace(0, dim, slices + 1).astype(int)
    q_rest = np.sqrt(np.maximum(0, np.cumsum((qr ** 2)[:, ::-1], 1)[:, ::-1]))
    x_rest = np.sqrt(np.maximum(0, np.cumsum((xr ** 2)[:, ::-1], 1)[:, ::-1]))
    q_len = q_rest[:, 0] if dim else np.zeros(len(q))
    x_len = x_rest[:, 0] if dim else np.zeros(len(x))
    slack = 1e-9 * dim * (1 + q_len * (x_len.max(initial=0)))
    head = min(len(x), max(64, 4 * k))  # the longest vectors, scored in full, set the first floor
    partial = qr @ xr[:head].T
    partial[np.asarray(q_ids)[:, None] == np.asarray(x_ids)[None, :head]] = -np.inf
    floor = np.full(len(q), -np.inf)
    if head > k:
        floor = np.partition(partial, head - k, 1)[:, head - k]
    for i in range(len(q)):
        # Falling length: from the first vector on whose length bound fails, none can pass.
        reach = len(x)
        if np.isfinite(floor[i]) and q_len[i] > 0:
            reach = int(np.searchsorted(-(x_len * q_len[i] + slack[i]), -floor[i], "right"))
        live = np.arange(reach)
        total = np.zeros(reach)
        for a, b in zip(cuts[:-1], cuts[1:]):
            total = total + xr[live, a:b] @ qr[i, a:b]
            rest = q_rest[i, b] * x_rest[live, b] if b < dim else 0.0
            stay = total + rest + slack[i] >= floor[i]
            live, total = live[stay], total[stay]
        other = x_ids[live] != q_ids[i]
        live, total = live[other], total[other]
        if len(live) > k:
            kth = np.partition(total, len(total) - k)[len(total) - k]
            live = live[total >= kth - 2 * slack[i]]
        scored = sorted(zip([-s for s in _scores(q[i], x[live])], x_ids[live].tolist()))[:k]
        out_q += [int(q_ids[i])] * len(scored)
        out_x += [v for _, v in scored]
        out_s += [-s for s, _ in scored]
    return out_q, out_x, out_s


def _blocks(v: DataFrame, size: int, partitions: int) -> DataFrame:
    """Rows (dim, block, ids, x, longest) of up to ``size`` vectors each, by falling length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def out(dim, part):
            m = np.stack(part["x"].to_numpy()) if dim else np.zeros((len(part), 0))
            ids = part["vec_id"].to_numpy(np.int64)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "x": [m.astype("<f8").tobytes()], "n": [len(ids)]})

        for b in batches:
            for dim, part in b.groupby("dim", sort=False):
                held.setdefault(int(dim), []).append(part)
                if sum(map(len, held[int(dim)])) >= size:
                    full = pd.concat(held.pop(int(dim)))
                    for at in range(0, len(full) - size + 1, size):
                        yield out(int(dim), full.iloc[at:at + size])
                    if len(full) % size:
                        held[int(dim)] = [full.iloc[len(full) - len(full) % size:]]
        for dim, parts in held.items():
            yield out(dim, pd.concat(parts))

    ordered = v.repartitionByRange(partitions, F.desc("sq"), "vec_id").sortWithinPartitions(F.desc("sq"), "vec_id")
    return ordered.select("vec_id", "x", "dim").mapInPandas(run, "dim int, ids binary, x binary, n long")


def top_inner_products(spark: SparkSession, vectors: DataFrame, queries: str, k: int, vec_id: str = "vec_id",
                       vector: str = "embedding", scale: int = SCALE, query_block: int = 512,
                       vector_block: int = 4096, tile: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each row that ``queries`` selects.

    ``queries`` is a SQL condition on vec_id. Tiles of ``tile`` x ``tile`` blocks are the unit of
    work, so a task holds a few blocks, whatever the size of the table.
    """
    rows = quantised(vectors, vec_id, vector, scale)
    v = saved(spark, rows.dropDuplicates(["vec_id", "x"]), "vectors")
    n = v.count()
    turn = spark.sparkContext.broadcast(rotations(v))
    asked = v.filter(queries)
    blocks = _blocks(v, vector_block, max(1, -(-n // vector_block)))
    asked_blocks = _blocks(asked, query_block, max(1, -(-asked.count() // query_block)))
    blocks, asked_blocks = saved(spark, _numbered(blocks), "blocks"), saved(spark, _numbered(asked_blocks), "queries")
    tiles = blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    q_tiles = asked_blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    wide = blocks.select("dim", "ids", "x", (F.col("block") % -(-tiles // tile) if tiles else F.lit(0)).alias("xt"),
                         F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-q_tiles // tile) - 1)))).alias("qt"))
    asked_wide = asked_blocks.select("dim", F.col("ids").alias("q_ids"), F.col("x").alias("q"),
                                     (F.col("block") % -(-q_tiles // tile) if q_tiles else F.lit(0)).alias("qt"),
                                     F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-tiles // tile) - 1)))).alias("xt"))
    pairs = wide.join(asked_wide, ["dim", "xt", "qt"]).select("dim", "ids", "x", "q_ids", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x_ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                x = np.frombuffer(r.x, "<f8").reshape(len(x_ids), r.dim)
                q = np.frombuffer(r.q, "<f8").reshape(len(q_ids), r.dim)
                rotation = turn.value.get(r.dim, np.eye(r.dim))
                a, c, s = block_top_k(q_ids, q, x_ids, x, rotation, k)
                yield pd.DataFrame({"query_id": np.asarray(a, np.int64), "vec_id": np.asarray(c, np.int64), "score": np.asarray(s, np.int64)})

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with numbers from 0 on without large gaps: partition number, then place in it."""
    return blocks.withColumn("block", F.spark_partition_id())
