"""Language identification by rank-order n-gram profiles.

Every language's profile is the ranking of its most frequent character n-grams (1 to 3 letters,
words padded with a border mark) over all its learning texts. A text's own ranking is compared
with each profile: an n-gram costs the difference of its two ranks, or ``profile`` if the
language does not rank it; the language with the least total out-of-place distance wins.

Counting runs in numpy inside the tasks, on integer codes of the n-grams; tasks send one row
for each language and n-gram. Only profiles (``profile`` rows a language) reach the driver.

Defined cases: texts that are NULL or have no letter get ``und`` with score 0, as does every
text if nothing could be learned; equal distances go to the alphabetically first language;
repeated rows count and are judged each; rows with a NULL id are judged (held_out false) but
not learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelens.llm.common import column, in_fold, text_slices

PROFILE = 400
UNDETERMINED = "und"
BORDER = np.int64(1)
PART = 400_000
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters (built once for each worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-letter n-grams of a text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    symbols = np.where(letter, points, 1).astype(np.int64)
    keep = np.ones(len(symbols), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one border for a run of other characters
    symbols = np.concatenate(([BORDER], symbols[keep], [BORDER]))
    codes, counts = [], []
    for at in range(0, len(symbols), PART):
        s = symbols[at:at + PART + 2]
        own = min(PART, len(symbols) - at)
        one, two = s[:own], s[:-1][:own] | (s[1:] << 21)[:own]
        three = s[:-2][:own] | (s[1:-1] << 21)[:own] | (s[2:] << 42)[:own]
        parts = [one[one != BORDER],
                 two[(two & 0x1FFFFF != 1) | (two >> 21 != 1)],
                 three[(three >> 21) & 0x1FFFFF != 1]]
        c, n = np.unique(np.concatenate(parts), return_counts=True)
        codes.append(c)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    return summed(codes, counts)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, rankings: dict[str, list[int]], size: int):
        self.size = size
        self.languages = sorted(rankings)
        self.codes = np.unique(np.asarray([c for r in rankings.values() for c in r], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)  # last row: unknown
        for j, name in enumerate(self.languages):
            self.rank[np.searchsorted(self.codes, rankings[name]), j] = np.arange(len(rankings[name]))

    def judge(self, text: str) -> tuple[str, float]:
        """Nearest language and 1 - its distance as a share of the greatest possible one."""
        codes, counts = ngram_counts(text)
        if not len(codes) or not len(self.codes):
            return UNDETERMINED, 0.0
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at[self.codes[at] != top] = len(self.codes)
        rank = self.rank[at]
        cost = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None]))
        distance = cost.sum(0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.size * len(top)))


def learned_profiles(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from ``docs`` (text, lang); rows with a NULL text or lang teach nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}

        def fold(name):
            held[name] = tuple([x] for x in summed(*held[name]))

        for batch in batches:
            for part, texts in text_slices(batch):
                for name, text in zip(column(part, "lang").to_pylist(), texts):
                    c, n = ngram_counts(text)
                    held.setdefault(name, ([], []))
                    held[name][0].append(c)
                    held[name][1].append(n)
                for name, (c, _) in list(held.items()):
                    if sum(map(len, c)) > 2_000_000:
                        fold(name)
        for name in held:
            c, n = summed(*held[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(c), pa.array(n)], ["lang", "code", "n"])

    counts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(
        count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    rankings: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # at most ``size`` rows a language
        rankings.setdefault(r["lang"], []).append(r["code"])
    return Profiles(rankings, size)


def identified(spark: SparkSession, docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for ``docs`` (doc_id, held_out, text)."""
    model = spark.sparkContext.broadcast(profiles)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, texts in text_slices(batch):
                said = [m.judge(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), pa.array([s[0] for s in said], pa.string()),
                     pa.array([s[1] for s in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(spark: SparkSession, docs: DataFrame, modulus: int = 3, remainder: int = 1, size: int = PROFILE) -> DataFrame:
    """Learn outside the fold that crc32(doc_id) mod ``modulus`` = ``remainder`` holds out, judge all rows."""
    fold = in_fold("doc_id", modulus, remainder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), "text")
    return identified(spark, rows, learned_profiles(docs.filter(~fold), size))
