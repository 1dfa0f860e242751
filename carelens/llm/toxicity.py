"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is the log-odds that a text holding it is toxic, relative to the base rate.
Counts are shrunk by Dirichlet priors along a chain (whole vocabulary, prefixes of growing length,
the word): each step's prior is the estimate of the step before, so a new word takes after words
that begin alike. A linear scan (all maximal scoring segments, left to right with a stack) finds
every passage whose score sum cannot be raised by growing or shrinking it. A passage's chance
level under clean text follows an extreme-value law, fitted to the best passages of the clean
learning texts; a text's passages are aggregated to evidence, and a logistic curve turns
evidence into a probability.

Labelled rows: the model is fitted on at most ``sample`` labelled texts (those with the least
hashed ids, a sample of fixed size and so broadcast as ids); all texts are scored whole.

Defined cases: NULL and empty texts have no passage and get the score of a text without
evidence; a text with several labels is toxic if one says so; NULL labels are left out;
repeated rows are scored each, and are learned once; a NULL doc_id is scored (held_out false), never
learned; without both labels the score is the base rate (0 without labels); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, in_fold, kept_by, saved, text_slices

SAMPLE = 20_000
PREFIXES = (3, 4, 5, 6, 7)
WORD = re.compile(r"\w+")
#: Pseudo-counts of a prior, and what every token loses so that chance passages end.
PRIOR_WEIGHT, DRIFT = 4.0, 0.4
LEAST_DOCS = 3
#: A passage counts as significant below this chance level.
CHANCE = 0.1


def units(word: str) -> list[str]:
    """The chain of a word: its proper prefixes, marked, then itself."""
    return [*("^" + word[:n] for n in PREFIXES if len(word) > n), word]


class TokenOdds:
    """Scores of tokens from document counts by unit; ``own`` takes a text's own label out of them."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.base = math.log(max(toxic, 0.5) / max(clean, 0.5))
        self.caches: dict[int | None, dict[str, float]] = {None: {}, 0: {}, 1: {}}

    def score(self, word: str, own: int | None = None) -> float:
        cache = self.caches[own]
        s = cache.get(word)
        if s is None:
            t0, c0 = self.toxic - (own == 1), self.clean - (own == 0)
            rate = (t0 + 0.5) / (t0 + c0 + 1)
            first = rate
            for u in units(word):
                t, c = self.counts.get(u, (0, 0))
                t, c = t - (own == 1 and t > 0), c - (own == 0 and c > 0)
                rate = (t + PRIOR_WEIGHT * rate) / (t + c + PRIOR_WEIGHT)
            s = math.log(rate / (1 - rate)) - math.log(first / (1 - first)) - DRIFT
            if len(cache) > 300_000:
                cache.clear()
            cache[word] = s
        return s

    def scores(self, words: list[str], own: int | None = None) -> np.ndarray:
        """One score a token; odds come from documents, so a word tells once, and its repeats nothing."""
        cache = self.caches[own]
        out = [cache.get(w) for w in words]
        if None in out:
            out = [s if s is not None else self.score(w, own) for w, s in zip(words, out)]
        scores = np.asarray(out, np.float64)
        seen: set[str] = set()
        for i in np.flatnonzero(scores > 0).tolist():
            if words[i] in seen:
                scores[i] = -DRIFT
            seen.add(words[i])
        return scores


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal scoring segments, in order; linear time.

    Runs of positive scores enter a stack; each holds the score sums before it and at its end.
    A new run joins back to the last one that begins lower, if that one also ends lower.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at end, last one that begins lower
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in stack]


class ExtremeValue:
    """Chance level of a passage of score s in n tokens of clean text: 1 - exp(-k n exp(-rate s))."""

    def __init__(self, best: np.ndarray, lengths: np.ndarray):
        seen = best > 0
        if seen.sum() < 20:
            self.rate, self.log_k = 1.0, 0.0
            return
        s, n = best[seen], np.log(np.maximum(lengths[seen], 1.0))
        # Gumbel law with location (log k + log n) / rate and scale 1 / rate, from its quartiles:
        # odd clean texts (a few labels are wrong, too) do not move those.
        low, mid, high = (-math.log(-math.log(q)) for q in (0.25, 0.5, 0.75))
        rate = 1.0
        for _ in range(100):
            q1, q3 = np.quantile(s - n / rate, (0.25, 0.75))
            rate = 0.5 * (rate + min(max((high - low) / max(q3 - q1, 1e-6), 0.2), 5.0))
        self.rate = float(rate)
        self.log_k = float(self.rate * np.median(s - n / self.rate) - mid)

    def evidence(self, score: np.ndarray, tokens: int) -> np.ndarray:
        """-ln of the chance level of each passage."""
        log_e = self.log_k + math.log(max(tokens, 1)) - self.rate * score  # of the expected number
        expected = np.exp(np.minimum(log_e, 50))
        return np.where(expected < 1e-6, -log_e, -np.log(-np.expm1(-np.maximum(expected, 1e-300))))


def features(passages: np.ndarray, tokens: int, law: ExtremeValue) -> tuple[float, float]:
    """Evidence of the best passage and of all significant ones together, on log scales."""
    if not len(passages):
        return 0.0, 0.0
    e = law.evidence(passages, tokens)
    strong = e[e > -math.log(CHANCE)]
    return math.log1p(min(float(e.max()), 60.0)), math.log1p(min(float(strong.sum()), 400.0))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton's method."""
    m = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(m.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (p - y) + ridge * w
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Token odds, the extreme-value law of clean texts, and the calibration curve."""

    def __init__(self, odds: TokenOdds, law: ExtremeValue, weights: np.ndarray):
        self.odds, self.law, self.weights = odds, law, weights

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal passages (first token, end token, score) and the number of tokens."""
        words = WORD.findall(text.lower())
        return maximal_segments(self.odds.scores(words)) if words else [], len(words)

    def score(self, text: str) -> float:
        found, n = self.passages(text)
        x = features(np.asarray([p[2] for p in found]), n, self.law)
        z = float(self.weights @ np.asarray([1.0, *x]))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Code point spans of the significant passages, with their evidence."""
        words = list(WORD.finditer(text.lower())) if len(text.lower()) == len(text) else list(WORD.finditer(text))
        found = maximal_segments(self.odds.scores([m.group().lower() for m in words])) if words else []
        out = []
        for a, b, s in found:
            e = float(self.law.evidence(np.asarray([s]), len(words))[0])
            if e > -math.log(CHANCE):
                out.append((words[a].start(), words[b - 1].end(), e))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of at most ``sample`` labelled documents of ``docs`` (doc_id, text).

    Of rows that repeat an id one text (the last in order) is taken.
    """
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    there = ids.join(own.select("doc_id"), "doc_id", "left_semi")  # ids without a text take no place in the sample
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return saved(docs.sparkSession, rows, "labelled")


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on labelled ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1)."""
    rows = labelled_sample(docs, labels, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        held: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for part, texts in text_slices(batch):
                for toxic, t in zip(column(part, "toxic").to_pylist(), texts):
                    held[toxic == 1].update({u for w in set(WORD.findall(t.lower())) for u in units(w)} | {""})
        for toxic, c in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array([v if toxic else 0 for v in c.values()], pa.int64()),
                 pa.array([0 if toxic else v for v in c.values()], pa.int64())], ["unit", "toxic", "clean"])

    table = rows.mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(f"unit = '' OR toxic + clean >= {LEAST_DOCS}").toPandas()
    counts = dict(zip(table["unit"], zip(table["toxic"].astype(int).tolist(), table["clean"].astype(int).tolist())))
    toxic, clean = counts.pop("", (0, 0))
    odds = TokenOdds(counts, toxic, clean)
    if not toxic or not clean:
        rate = (toxic + 1e-3) / (toxic + clean + 2e-3) if toxic + clean else 1e-9
        return ToxicityModel(TokenOdds({}, 1, 1), ExtremeValue(np.empty(0), np.empty(0)), np.asarray([math.log(rate / (1 - rate)), 0.0, 0.0]))
    shared = spark.sparkContext.broadcast(odds)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        o = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                said = [1 if t == 1 else 0 for t in column(part, "toxic").to_pylist()]
                found, n = [], []
                for own, t in zip(said, texts):
                    words = WORD.findall(t.lower())
                    n.append(len(words))
                    found.append(sorted((x[2] for x in maximal_segments(o.scores(words, own))), reverse=True) if words else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(said, pa.int32()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "passages"])

    seen = rows.mapInArrow(best, "toxic int, n long, passages array<double>").toPandas()  # at most ``sample`` rows
    y, n = seen["toxic"].to_numpy(np.float64), seen["n"].to_numpy(np.float64)
    top = np.asarray([p[0] if len(p) else 0.0 for p in seen["passages"]])
    law = ExtremeValue(top[y == 0], n[y == 0])
    x = np.asarray([features(np.asarray(p, np.float64), int(k), law) for p, k in zip(seen["passages"], n)])
    return ToxicityModel(odds, law, logistic_fit(x, y))


def scored(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for ``docs`` (doc_id, held_out, text)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        m = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                s = [m.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), pa.array(s, pa.float64()),
                     pa.array([1 if v >= 0.5 else 0 for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(spark: SparkSession, docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (with a column text) that score below ``threshold``, all columns as they are."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        m = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array([m.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
             sample: int = SAMPLE) -> DataFrame:
    """Learn outside the fold that crc32(doc_id) mod ``modulus`` = ``remainder`` holds out, score all rows."""
    fold = in_fold("doc_id", modulus, remainder)
    model = learned(spark, docs.filter(~fold), labels.filter(~fold), sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), "text")
    return scored(spark, rows, model)
