"""Phrase collocations of two or three words, by best-first branch and bound over prefixes.

A phrase scores floor(SCALE a^2 / (l r)) at its lowest-scoring cut, where a, l and r count the phrase and its two
parts. Phrases grow from prefixes. As r >= a, no phrase that begins with the words (v, w) scores more
than SCALE f(v w) / f(v): the prefix counts give an admissible bound. Words counted less than
LEAST times cannot stand in any candidate and end a piece.

The frontier is expanded from the best bound down, a block of bounds at a time. For every language a block goes
down to the score that the 4000th (then the 16,000th, ...) best two-word phrase has, ties included: the
extensions of all prefixes with such a bound are counted, and those to the left of all two-word
phrases with such a score. All phrases that score as much are then known, and it is known which of
them a longer phrase covers. A language is settled when its TOP-th surviving score is not below the
block's bound, or nothing is left to expand. All counts cover all texts.

Words are 63-bit hashes of language and word while phrases are counted; the vocabulary shows whether two
words share one, and another seed is taken then, so counts are exact. Which words or prefixes count is
told to the tasks by Bloom filters of a fixed size: a false positive is counted in vain, and
filters too small for a corpus only prune less. Counts are added up in the tasks before any shuffle.

Defined cases: a NULL text is empty, a NULL lang is ``und``; NULL doc_id and repeated rows count
like others; a language with fewer survivors returns all of them; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, saved, text_slices
from carelens.llm.spelling import lower_ascii

#: The characters at which texts are cut into pieces (pieces are cut into words at blanks and tabs).
BREAKS = "\n.,;:!?\x0b\x0c\r"
SCALE = 1_000_000
LEAST = 10
TOP = 2000
#: A longer candidate covers a phrase if it is at least so many hundredths as frequent.
COVER = 50
#: Bits of a filter (4 MB).
FILTER_BITS = 1 << 25
HELD_WORDS = 120_000
#: Words handled at a time when phrases are counted.
PART = 1 << 19
#: Words in a row of coded texts.
ROW = 512
BREAK, NOTHING = -1, -2


def word_hash(lang: str, word: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{lang}\n{word}".encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") >> 1


def tokens(texts: list[str]) -> list[str]:
    """The words of texts, with a line feed for each piece end (also between texts) and empty strings to be left out."""
    s = lower_ascii("\n".join(texts)).replace("\t", " ")
    for c in BREAKS:
        if c in s:
            s = s.replace(c, " \n ")
    return s.split(" ")


def _language_rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("coalesce(CAST(lang AS string), 'und') AS lang", "text")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) of a batch, about a megabyte of text at a time."""
    for part, texts in text_slices(batch):
        groups: dict[str, list[str]] = defaultdict(list)
        for lang, text in zip(column(part, "lang").to_pylist(), texts):
            groups[lang].append(text)
        yield from groups.items()


def vocabulary(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, n for every word of ``docs`` (text, lang); the seed with which no two share h)."""
    for seed in range(1 << 30):
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            held: dict[str, Counter] = defaultdict(Counter)

            def out() -> Iterator[pa.RecordBatch]:
                for lang, own in held.items():
                    words = [w for w in own if w and w != "\n"]
                    for at in range(0, len(words), 50_000):
                        part = words[at:at + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                             pa.array([word_hash(lang, w, seed) for w in part], pa.int64()), pa.array([own[w] for w in part], pa.int64())],
                            ["lang", "word", "h", "n"])
                held.clear()

            for batch in batches:
                for lang, texts in _by_language(batch):
                    held[lang].update(tokens(texts))
                    if sum(map(len, held.values())) > HELD_WORDS:
                        yield from out()
            yield from out()

        found = _language_rows(docs).mapInArrow(run, "lang string, word string, h long, n long")
        words = saved(spark, found.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "vocabulary")
        if not words.groupBy("h").count().filter("count > 1").take(1):
            return words, seed
    raise AssertionError("unreachable")


def _mixed(*keys: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number of each row of keys."""
    x = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        x = (x ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _bits(mixed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of each number."""
    return mixed % np.uint64(size), (mixed >> np.uint64(32)) * np.uint64(0x85EBCA6B) % np.uint64(size)


class Filter:
    """A Bloom filter over rows of hashes."""

    def __init__(self, size: int):
        self.size = size
        self.cells = np.zeros(size // 64, np.uint64)

    def has(self, *keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys[0]), bool)
        for b in _bits(_mixed(*keys), self.size):
            out &= (self.cells[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)) > 0
        return out


def filter_of(rows: DataFrame, keys: list[str], size: int = FILTER_BITS) -> Filter:
    """A filter that holds the rows of hashes. Its cells are joined by Spark; only the whole (of fixed size) comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = _mixed(*(column(batch, k).to_numpy() for k in keys))
            bit = np.unique(np.concatenate(_bits(mixed, size)))
            cell = bit >> np.uint64(6)
            first = np.flatnonzero(np.diff(cell.astype(np.int64), prepend=-1))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int64)), pa.array(bits.view(np.int64))], ["cell", "bits"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [column(batch, c).to_numpy().tobytes() for c in ("cell", "bits")]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["cells", "bits"])

    cells = rows.select(*keys).mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits"))
    out = Filter(size)
    for r in cells.mapInArrow(packed, "cells binary, bits binary").collect():  # size / 64 cells at most
        out.cells[np.frombuffer(r["cells"], np.int64)] = np.frombuffer(r["bits"], np.uint64)
    return out


def coded_texts(spark: SparkSession, docs: DataFrame, seed: int, frequent: Filter) -> DataFrame:
    """seq: the hashes of the words of some texts of a language (packed), BREAK for piece ends and rare words."""
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                words = tokens(texts)
                own = known.setdefault(lang, {"": NOTHING, "\n": BREAK})
                codes = list(map(own.get, words))
                new = list({w for w, c in zip(words, codes) if c is None})
                if new:
                    if sum(map(len, known.values())) + len(new) > HELD_WORDS:
                        known.clear()
                        own = known[lang] = {"": NOTHING, "\n": BREAK}
                        new = list(set(words) - {"", "\n"})
                    h = np.fromiter((word_hash(lang, w, seed) for w in new), np.int64, len(new))
                    h[~shared.value.has(h)] = BREAK
                    own.update(zip(new, h.tolist()))
                    codes = map(own.__getitem__, words)
                s = np.fromiter(codes, np.int64, len(words))
                s = s[s != NOTHING]
                # Pieces of one word hold no phrase.
                live = s != BREAK
                near = np.zeros(len(s), bool)
                near[1:] |= live[:-1]
                near[:-1] |= live[1:]
                s = np.where(live & near, s, BREAK)
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != BREAK) | (s[:-1] != BREAK)
                s = s[keep]
                # Small rows, cut where pieces end, so that Arrow batches stay small.
                ends = np.flatnonzero(s == BREAK)
                cuts = np.unique(np.append(ends, len(s))[np.searchsorted(ends, np.arange(ROW, len(s) + ROW, ROW))])
                rows = [x.tobytes() for x in np.split(s, cuts) if len(x) > 1]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["seq"])

    return saved(spark, _language_rows(docs).mapInArrow(run, "seq binary"), "coded")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The texts in a row, with a BREAK after each row, about PART words at a time (one row at least)."""
    stop = np.asarray([BREAK], np.int64).tobytes()
    held, size = [], 0
    for batch in batches:
        for x in column(batch, "seq"):
            x = x.as_buffer()
            if held and size + x.size > 8 * PART:
                yield np.frombuffer(b"".join(held), np.int64)
                held, size = [], 0
            held += [x, stop]
            size += x.size + 8
    if held:
        yield np.frombuffer(b"".join(held), np.int64)


def pair_counts(coded: DataFrame) -> DataFrame:
    """h1, h2, a: two-word phrases that occur LEAST times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _flat(batches):
            names, own = np.unique(s, return_inverse=True)
            at = np.flatnonzero((s[:-1] != BREAK) & (s[1:] != BREAK))
            pair, n = np.unique(own[at] * len(names) + own[at + 1], return_counts=True)
            for i in range(0, len(pair), 200_000):
                some = pair[i:i + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some // len(names)]), pa.array(names[some % len(names)]), pa.array(n[i:i + 200_000])], ["h1", "h2", "n"])

    found = coded.mapInArrow(run, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST)


def triple_counts(coded: DataFrame, pairs: Filter, prefixes: Filter, suffixes: Filter) -> DataFrame:
    """h1, h2, h3, a: three-word phrases that occur LEAST times and begin with one of ``prefixes`` or end with one of ``suffixes``."""
    shared = coded.sparkSession.sparkContext.broadcast((pairs, prefixes, suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, prefixes, suffixes = shared.value
        for s in _flat(batches):
            live = s != BREAK
            at = np.flatnonzero(live[:-2] & live[1:-1] & live[2:])
            at = at[prefixes.has(s[at], s[at + 1]) | suffixes.has(s[at + 1], s[at + 2])]
            at = at[pairs.has(s[at], s[at + 1]) & pairs.has(s[at + 1], s[at + 2])]
            if not len(at):
                continue
            names, own = np.unique(np.concatenate((s[at], s[at + 1], s[at + 2])), return_inverse=True)
            own = own.reshape(3, -1)
            firsts, first = np.unique(own[0] * len(names) + own[1], return_inverse=True)
            triple, n = np.unique(first * len(names) + own[2], return_counts=True)
            pair = firsts[triple // len(names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(names[triple % len(names)]), pa.array(n)],
                ["h1", "h2", "h3", "n"])

    found = coded.mapInArrow(run, "h1 long, h2 long, h3 long, n long")
    return found.groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST)


def score_sql(a: str, l: str, r: str) -> str:
    """Exact floor(SCALE a^2 / (l r)) for counts below 10^15."""
    return f"(CAST({SCALE} AS decimal(38, 0)) * {a} * {a}) div (CAST({l} AS decimal(38, 0)) * {r})"


def _cuts(pairs: DataFrame, rank: int) -> DataFrame:
    """lang, cut: the score of the ``rank``-th best row of a language, 0 if there are fewer."""
    # At most SCALE + 1 rows a language meet in a window.
    best = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "upto", F.expr("sum(n) OVER (PARTITION BY lang ORDER BY score DESC)"))
    return best.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("cut"))


def collocations(spark: SparkSession, docs: DataFrame, top: int = TOP, first_rank: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs`` (text, lang)."""
    words, seed = vocabulary(spark, docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = saved(spark, words.filter(F.col("n") >= LEAST), "frequent")
    coded = coded_texts(spark, docs, seed, filter_of(frequent, ["h"]))
    one = frequent.select("lang", "h", F.col("n").alias("f"))
    pairs = pair_counts(coded).join(one.withColumnRenamed("h", "h1").withColumnRenamed("f", "l"), "h1").join(
        one.selectExpr("h AS h2", "f AS r"), "h2")
    pairs = saved(spark, pairs.selectExpr(
        "lang", "h1", "h2", "a", "l", "r", f"{score_sql('a', 'l', 'r')} AS score", f"(CAST({SCALE} AS decimal(38, 0)) * a) div l AS bound"), "pairs")
    known = filter_of(pairs, ["h1", "h2"])
    two = pairs.select("h1", "h2", F.col("a").alias("f"))
    rank = first_rank or 2 * top
    cuts = saved(spark, pairs.select("lang").distinct().withColumn("cut", F.lit(SCALE + 1).cast("long")), "cuts")
    triples, settled = None, spark.createDataFrame([], "lang string")
    while True:
        # Settled languages keep their cut, so they have nothing new to expand.
        lower = cuts.join(_cuts(pairs, rank).withColumnRenamed("cut", "below"), "lang").join(
            settled.withColumn("done", F.lit(True)), "lang", "left").selectExpr(
            "lang", "cut AS before", "IF(coalesce(done, false), cut, least(cut, below)) AS cut")
        lower = saved(spark, lower, "cuts")
        block = pairs.join(lower, "lang")
        new = triple_counts(coded, known, filter_of(block.filter("bound >= cut AND bound < before"), ["h1", "h2"]),
                            filter_of(block.filter("score >= cut AND score < before"), ["h1", "h2"]))
        # A phrase can come again by a filter's false positive, with the same count.
        triples = saved(spark, new if triples is None else triples.unionByName(new).distinct(), "triples")
        three = triples.join(one.selectExpr("lang", "h AS h1", "f AS l1"), "h1").join(
            two.selectExpr("h1 AS h2", "h2 AS h3", "f AS r1"), ["h2", "h3"]).join(
            two.selectExpr("h1", "h2", "f AS l2"), ["h1", "h2"]).join(one.selectExpr("h AS h3", "f AS r2"), "h3").selectExpr(
            "*", f"{score_sql('a', 'l1', 'r1')} AS s1", f"{score_sql('a', 'l2', 'r2')} AS s2").selectExpr(
            "lang", "h1", "h2", "h3", "a", "IF(s1 <= s2, l1, l2) AS l", "IF(s1 <= s2, r1, r2) AS r", "least(s1, s2) AS score")
        inside = triples.selectExpr("h1", "h2", "a AS longer").unionByName(triples.selectExpr("h2 AS h1", "h3 AS h2", "a AS longer"))
        most = inside.groupBy("h1", "h2").agg(F.max("longer").alias("longer"))
        free = pairs.join(most, ["h1", "h2"], "left").filter(f"longer IS NULL OR 100 * longer < {COVER} * a").selectExpr(
            "lang", "h1", "h2", "CAST(NULL AS long) AS h3", "a", "l", "r", "score")
        alive = saved(spark, free.unionByName(three).join(lower, "lang").filter("score >= cut"), "alive")
        # All that score at least the cut are known: settled with ``top`` of them, or at a cut of 0.
        enough = alive.groupBy("lang").count().withColumnRenamed("count", "have")
        state = saved(spark, lower.join(enough, "lang", "left").selectExpr("lang", "cut", f"cut = 0 OR coalesce(have, 0) >= {int(top)} AS done"), "state")
        cuts, settled = state.select("lang", "cut"), state.filter("done").select("lang")
        if not state.filter("NOT done").take(1):
            break
        rank *= 4
    name = words.select("h", "word")
    named = alive.join(name.selectExpr("h AS h1", "word AS w1"), "h1").join(name.selectExpr("h AS h2", "word AS w2"), "h2").join(
        name.selectExpr("h AS h3", "word AS w3"), "h3", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    ranked = named.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).filter(
        F.col("rank") <= top)
    return ranked.join(totals, "lang").selectExpr(
        "lang", "CAST(rank AS long) AS rank", "phrase", "a", "l", "r", "total AS n", "CAST(score AS long) AS score")
