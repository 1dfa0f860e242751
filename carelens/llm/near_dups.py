"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles, as 64-bit hashes. The signature uses two
permutations of the 32-bit numbers: the first places the shingles, the second, shifted by one
place for each coordinate, ranks them; coordinate k is the least rank under shift k. Bands of
coordinates give candidate groups.

* Documents with one and the same set are one node from the start.
* Groups that share nodes form a cluster. A cluster's sets are dealt into blocks of bounded
  size. Within a block all pairs that share a band are confirmed on the full sets (shared
  shingles are counted by matrix products); a block also holds the cluster's most central set.
  One cluster of any size is thus spread over many tasks, and each task returns only a spanning
  forest of the links that it confirmed.
* For clusters of several blocks a second round confirms what may still join components: sets
  outside the cluster's main component, in blocks, against all blocks. Pairs that share a band
  and lie in different components are checked, so no such link is lost.

A pair at the threshold misses all bands with a probability of about (1 - 0.75 ** 4) ** 32 = 5e-6.

Defined cases: a document without words, or a NULL text, is linked with nothing; fewer words than a
shingle make one shingle; a NULL doc_id takes no part (component NULL, kept); rows that repeat
a doc_id are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, kept_by, saved, text_slices
from carelens.llm.components import components

WORDS = 5
BANDS, ROWS = 32, 4
#: Nodes, and megabytes of their sets, that one block holds on average.
BLOCK_NODES, BLOCK_MB = 512, 8
#: Odd multipliers that make a shingle's hash depend on the order of its words.
PLACE = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class _WordHash(dict):
    """64-bit hashes of words, remembered; emptied by its user when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers that spreads all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct ``words``-word shingles of a text (A-Z lower-cased)."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h += a[j:len(w) - n + 1 + j] * (PLACE[j % len(PLACE)] + np.uint64(2 * (j // len(PLACE))))
    return np.unique(_mixed(h))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Least ranks of a set under ``size`` circular shifts of the second permutation."""
    placed = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 20) // size)
    for at in range(0, len(placed), step):
        x = placed[None, at:at + step] - np.arange(size, dtype=np.uint32)[:, None]
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(1), out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = _mixed(h * PLACE[0] + sig[r::rows][:bands])
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, fp (hash of the set, NULL if empty), bands (64-bit keys as bytes)."""
    schema = "doc_id long, n_shingles long, fp binary, bands binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_dups")
        hashes = _WordHash()
        for batch in batches:
            for part, texts in text_slices(batch):
                if len(hashes) > 400_000:
                    hashes.clear()
                n, fp, keys = [], [], []
                for t in texts:
                    s = shingle_set(t, hashes, words)
                    n.append(len(s))
                    fp.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                    keys.append(band_keys(signature(s, bands * rows), bands, rows).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.binary())],
                    ["doc_id", "n_shingles", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """fp, shingles (sorted 64-bit hashes as bytes) for ``docs`` (fp, text); other sets' rows go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_dups")
        hashes = _WordHash()
        for batch in batches:
            for part, texts in text_slices(batch):
                if len(hashes) > 400_000:
                    hashes.clear()
                fps, sets = [], []
                for fp, t in zip(column(part, "fp").to_pylist(), texts):
                    s = shingle_set(t, hashes, words).tobytes()
                    if xxhash.xxh128_digest(s) == fp:
                        fps.append(fp)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return docs.select("fp", "text").mapInArrow(run, "fp binary, shingles binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right`` (sorted sets).

    Only elements on both sides count; they are columns of 0/1 matrices that are multiplied
    ``width`` columns at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(common):
        return out

    def places(sets, flat):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    (ra, ca), (rb, cb) = places(left, a), places(right, b)
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for at in range(0, len(common), width):
        ia, ja = np.searchsorted(ca, [at, at + width])
        ib, jb = np.searchsorted(cb, [at, at + width])
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ra[ia:ja], ca[ia:ja] - at] = 1
        y[rb[ib:jb], cb[ib:jb] - at] = 1
        out += x @ y.T
    return out


def confirmed(left: list[np.ndarray], right: list[np.ndarray], candidate: np.ndarray, percent: int) -> np.ndarray:
    """Candidate pairs whose Jaccard similarity is at least ``percent`` / 100, as a 0/1 matrix."""
    out = np.zeros(candidate.shape, bool)
    step = 256
    for i in range(0, len(left), step):
        for j in range(0, len(right), step):
            c = candidate[i:i + step, j:j + step]
            if not c.any():
                continue
            rows, cols = np.flatnonzero(c.any(1)), np.flatnonzero(c.any(0))
            x, y = [left[i + r] for r in rows], [right[j + k] for k in cols]
            if c.sum() <= 64:  # a few pairs: one by one
                for r, k in zip(*np.nonzero(c)):
                    s, t = left[i + r], right[j + k]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    out[i + r, j + k] = 100 * both >= percent * (len(s) + len(t) - both)
                continue
            both = shared_counts(x, y).astype(np.int64)
            union = np.asarray([len(s) for s in x])[:, None] + np.asarray([len(s) for s in y])[None, :] - both
            out[i + rows[:, None], j + cols[None, :]] = (100 * both >= percent * union) & c[np.ix_(rows, cols)]
    return out


def sharing_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs with an equal key in one band at least (keys: one row for each set)."""
    out = np.zeros((len(left), len(right)), bool)
    for b in range(left.shape[1]):
        out |= left[:, b][:, None] == right[:, b][None, :]
    return out


def forest(n: int, links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of links among n nodes."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _arrays(group: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    return sets, np.stack([np.frombuffer(b, np.int64) for b in group["bands"]])


def _links(fps_a, fps_b, pairs) -> pd.DataFrame:
    return pd.DataFrame({"a": [fps_a[i] for i, _ in pairs], "b": [fps_b[j] for _, j in pairs]})


def _within_block(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("fp").sort_values("fp", ignore_index=True)
        sets, bands = _arrays(group)
        candidate = np.triu(sharing_band(bands, bands), 1)
        found = confirmed(sets, sets, candidate, percent)
        fps = group["fp"].tolist()
        return _links(fps, fps, forest(len(fps), zip(*(x.tolist() for x in np.nonzero(found)))))
    return run


def _across_blocks(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["outside"]].sort_values("fp"), group[~group["outside"]].sort_values("fp")
        if not len(left) or not len(right):
            return _links([], [], [])
        (s, k), (t, m) = _arrays(left), _arrays(right)
        own, other = left["comp"].to_numpy(), right["comp"].to_numpy()
        candidate = sharing_band(k, m) & (own[:, None] != other[None, :])
        found = confirmed(s, t, candidate, percent)
        pairs = [(i, len(left) + j) for i, j in zip(*(x.tolist() for x in np.nonzero(found)))]
        fps = [*left["fp"], *right["fp"]]
        return _links(fps, fps, forest(len(fps), iter(pairs)))
    return run


def near_links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Links (a, b) between sets that span the components of all confirmed pairs.

    ``nodes``: fp, rep (a doc_id with that set), bands; ``docs``: doc_id, text.
    """
    keys = nodes.select("fp", F.explode(_band_array("bands")).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("first")).filter("size > 1")
    members = saved(spark, keys.join(sizes, "bucket"), "members")
    clusters = components(spark, members.select(F.col("first").alias("a"), F.col("fp").alias("b")))
    central = members.groupBy("fp").agg(F.sum(F.col("size") - 1).alias("central"))
    # Sets are made again only for documents in a cluster.
    wanted = nodes.join(clusters.withColumnRenamed("node", "fp"), "fp").join(central, "fp")
    wanted = saved(spark, wanted.select("fp", "rep", "bands", "central", F.col("root").alias("cluster")), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep", "fp"), "rep")
    sets = saved(spark, full_sets(texts, words).dropDuplicates(["fp"]).join(wanted.drop("rep"), "fp"), "sets")
    shape = sets.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.octet_length("shingles")) / (BLOCK_MB << 20))).alias("blocks"),
        F.max(F.struct("central", "fp"))["fp"].alias("hub"))
    shape = saved(spark, shape, "shape")
    dealt = sets.join(shape, "cluster").withColumn("block", F.expr("pmod(xxhash64(fp), blocks)"))
    in_own = dealt.select("cluster", "block", "fp", "bands", "shingles")
    hubs = dealt.filter("fp = hub AND blocks > 1").select(
        "cluster", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "fp", "bands", "shingles")
    inner = in_own.unionByName(hubs).groupBy("cluster", "block").applyInPandas(_within_block(percent), "a binary, b binary")
    inner = saved(spark, inner, "inner")
    large = shape.filter("blocks > 1")
    if large.isEmpty():
        return inner
    comps = components(spark, inner).withColumnRenamed("node", "fp").withColumnRenamed("root", "comp")
    split = sets.join(large, "cluster").join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    split = saved(spark, split.select("fp", "bands", "shingles", "cluster", "blocks", "comp"), "split")
    main = split.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    outside = split.join(main, "cluster").filter("comp <> main").drop("main")
    outer = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("outer_blocks"))
    columns = ["cluster", "i", "j", "fp", "bands", "shingles", "comp", "outside"]
    left = outside.join(outer, "cluster").select(
        "*", F.expr("pmod(xxhash64(fp, 7), outer_blocks)").alias("i"),
        F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"), F.lit(True).alias("outside")).select(columns)
    right = split.join(outer, "cluster").select(
        "*", F.expr("pmod(xxhash64(fp), blocks)").alias("j"),
        F.explode(F.expr("sequence(0L, outer_blocks - 1)")).alias("i"), F.lit(False).alias("outside")).select(columns)
    across = left.unionByName(right).groupBy("cluster", "i", "j").applyInPandas(_across_blocks(percent), "a binary, b binary")
    return inner.unionByName(saved(spark, across, "across"))


def _band_array(bands: str):
    """The 64-bit band keys of a byte column as an array."""
    return F.expr(f"transform(sequence(0, octet_length({bands}) DIV 8 - 1), i -> substring({bands}, i * 8 + 1, 8))")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75, words: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    sig = saved(spark, signatures(docs, words, bands, rows), "signatures")
    nodes = sig.filter("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    nodes = saved(spark, nodes, "nodes")
    comps = components(spark, near_links(spark, docs, nodes, percent, words)).withColumnRenamed("node", "fp")
    owners = nodes.select("fp", "rep").join(comps, "fp")
    least = owners.groupBy("root").agg(F.min("rep").alias("least"))
    joined = nodes.select("fp", "rep").join(owners.join(least, "root").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "rep").alias("component_id"))
    return sig.select("doc_id", "n_shingles", "fp").join(joined, "fp", "left").select(
        "doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
