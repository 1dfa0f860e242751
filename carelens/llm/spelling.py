"""Spelling variants: words that differ by one inserted, deleted or replaced character.

Pivotal grams: bigrams are ranked by how rare they are. The PREFIX rarest ones of a word form its
prefix, and dynamic programming over their places picks two of them that do not overlap (pivots).
One edit cannot damage both. If the last prefix gram of a word t is as common as that of s or more
common, a pivot of s that survives the edit lies in the prefix of t. It lies at the same place from
the front if the edit is behind it, from the back if the edit is before it; and what the edit
cannot have touched is equal in both words:

* edit behind or inside the right pivot: the left one survives, with all before the right one;
* edit between the pivots: both survive, with all before and all behind them;
* edit before or inside the left pivot: the right one survives, with all behind the left one.

So a word asks three keys (each for the three lengths a partner may have) of an index that holds,
for every word and gram of its prefix, the keys which that gram can stand for. Matches are
verified by edit distance. The pivots chosen are those whose equal parts are rarest by the
frequencies of their bigrams.

Words are counted before any shuffle, keys are 64-bit hashes (a collision only costs a
verification), and adaptive execution can split a hot key. There are at most len(ALPHABET)^2
bigrams, so their frequencies are broadcast whatever the corpus.

Defined cases: a NULL text has no words; a NULL doc_id is written as nothing before the colon; repeated
rows count each; words of other lengths or letters do not occur; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, saved, text_slices

#: The characters of a run; A-Z are lower-cased before they are looked up.
RUN = "[A-Za-zÀ-ÿ]"
ALPHABET = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a form if it is so many times as frequent.
TIMES = 10
#: Rarest bigrams of a word in its prefix; three always hold two that do not overlap, a fourth gives a choice.
PREFIX = 4
HELD_WORDS = 400_000


def lower_ascii(text: str) -> str:
    """A-Z lower-cased and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def damaged(word: str, doc: str, every: int) -> str:
    """``word`` without one character if ``every`` divides the crc32 of doc:word."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{doc}:".encode()))
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage_every: int | None = None) -> DataFrame:
    """word, n: lower-cased runs of letters of ``docs`` (doc_id, text) with their occurrences.

    ``damage_every``: runs lose a character by ``damaged`` before they are counted.
    """
    find = re.compile(RUN + "{%d,}" % least_length).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for part, texts in text_slices(batch):
                for doc, text in zip(column(part, "doc").to_pylist(), texts):
                    own = find(lower_ascii(text))
                    if damage_every is None:
                        held.update(own)
                    else:
                        for w, n in Counter(own).items():
                            w = damaged(w, doc, damage_every)
                            if len(w) >= least_length:
                                held[w] += n
                    if len(held) > HELD_WORDS:
                        yield from out()
        yield from out()

    rows = docs.selectExpr("coalesce(CAST(doc_id AS string), '') AS doc", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _letters() -> np.ndarray:
    """Number of each code point in ALPHABET."""
    out = np.zeros(256, np.int64)
    out[ALPHABET] = np.arange(len(ALPHABET))
    return out


def _grams(words: list[str], length: int, letters: np.ndarray) -> np.ndarray:
    """Bigram numbers of words of one length: a row for each."""
    points = letters[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, length)
    return points[:, :-1] * len(ALPHABET) + points[:, 1:]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(length, places, words) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, [words[i] for i in at.tolist()]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each bigram occurs in the distinct ``words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = _letters(), np.zeros(len(ALPHABET) ** 2, np.int64)
        for batch in batches:
            for n, _, some in _by_length(column(batch, "word").to_pylist()):
                total += np.bincount(_grams(some, n, letters).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(ALPHABET) ** 2, np.int64)
    for r in found:  # at most one row per bigram of the alphabet
        out[r["gram"]] = r["n"]
    return out


def choose_pivots(rank: np.ndarray, log_share: np.ndarray, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the last prefix gram, left pivot, right pivot, is a place in the prefix) for words of one length.

    ``rank`` and ``log_share``: a row per word, a column per bigram. The share of words that agree
    with a part of a word is taken as the product over every second bigram of the part. The left
    pivot costs the share of what lies behind it, the right one the share of what lies before it.
    """
    rows, grams = rank.shape
    last = np.sort(rank, axis=1)[:, prefix - 1]
    inside = rank <= last[:, None]
    half = np.concatenate((np.zeros((rows, 1)), np.cumsum(log_share / 2, axis=1)), axis=1)
    left_cost = np.full((rows, grams), np.inf)
    left_cost[:, :-2] = half[:, -1:] - half[:, 2:-1]  # bigrams from two places on
    right_cost = np.full((rows, grams), np.inf)
    right_cost[:, 2:] = half[:, 1:grams - 1]  # bigrams that end before it
    # Dynamic programming over places: the best left pivot so far, then the best pair that ends here.
    best = np.full(rows, np.inf)
    left, right = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    best_left, best_left_at = np.full(rows, np.inf), np.zeros(rows, np.int64)
    for p in range(2, grams):
        new = inside[:, p - 2] & (left_cost[:, p - 2] < best_left)
        best_left[new], best_left_at[new] = left_cost[new, p - 2], p - 2
        cost = np.logaddexp(best_left, right_cost[:, p])
        new = inside[:, p] & np.isfinite(best_left) & (cost < best)
        best[new], left[new], right[new] = cost[new], best_left_at[new], p
    return last, left, right, inside


def pivots(words: DataFrame, counts: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """word, n, len, last, p, q, places: prefix and pivots of each word of ``words`` (word, n)."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts))
    share = np.log(np.maximum(counts, 1) / max(counts.sum(), 1))
    shared = words.sparkSession.sparkContext.broadcast((rank, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        rank, share = shared.value
        for batch in batches:
            for n, at, some in _by_length(column(batch, "word").to_pylist()):
                grams = _grams(some, n, letters)
                last, left, right, inside = choose_pivots(rank[grams], share[grams], prefix)
                row, place = np.nonzero(inside)
                cut = pa.array(np.searchsorted(row, np.arange(len(some) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.string()), column(batch, "n").take(pa.array(at)), pa.array(np.full(len(some), n), pa.int32()),
                     pa.array(last, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()),
                     pa.ListArray.from_arrays(cut, pa.array(place, pa.int32()))],
                    ["word", "n", "len", "last", "p", "q", "places"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, len int, last int, p int, q int, places array<int>")


def near_words(spark: SparkSession, words: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """word, n, near, near_n: every ordered pair of ``words`` (word, n) that one edit tells apart."""
    w = saved(spark, pivots(words, gram_counts(words), prefix), "pivots")
    ask = w.selectExpr("word", "n", "last", "explode(sequence(len - 1, len + 1)) AS size", "len", "p", "q").selectExpr("word", "n", "last", """
        explode(array(xxhash64(1, size, p, substring(word, 1, q)),
                      xxhash64(2, size, p, len - q, substring(word, 1, p + 2), substring(word, q + 1)),
                      xxhash64(3, size, len - q, substring(word, p + 3)))) AS key""")
    one = w.selectExpr("word", "n", "last", "len", "explode(places) AS at")
    front = one.selectExpr("word", "n", "last", "len", "at", "explode(sequence(at + 2, len)) AS m").selectExpr(
        "word", "n", "last", "xxhash64(1, len, at, substring(word, 1, m)) AS key")
    back = one.selectExpr("word", "n", "last", "len", "at", "explode(sequence(0, at)) AS m").selectExpr(
        "word", "n", "last", "xxhash64(3, len, len - at, substring(word, m + 1)) AS key")
    both = w.selectExpr("word", "n", "last", "len", "places", "explode(places) AS at").selectExpr(
        "word", "n", "last", "len", "at", "explode(filter(places, x -> x >= at + 2)) AS m").selectExpr(
        "word", "n", "last", "xxhash64(2, len, at, len - m, substring(word, 1, at + 2), substring(word, m + 1)) AS key")
    index = front.unionByName(back).unionByName(both)
    met = ask.alias("a").join(index.alias("b"), F.expr("a.key = b.key AND b.last >= a.last AND a.word <> b.word")).filter(
        "levenshtein(a.word, b.word, 1) = 1").selectExpr(
        "least(a.word, b.word) AS word", "greatest(a.word, b.word) AS near",
        "IF(a.word < b.word, a.n, b.n) AS n", "IF(a.word < b.word, b.n, a.n) AS near_n")
    pairs = saved(spark, met.distinct(), "near")
    return pairs.unionByName(pairs.selectExpr("near AS word", "word AS near", "near_n AS n", "n AS near_n"))


def variant_groups(spark: SparkSession, words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n).

    Forms are followed by doubling the steps; as each step multiplies n by ``times``, there are few.
    """
    words = saved(spark, words, "words")
    best = near_words(spark, words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    own = saved(spark, words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0) AS n_near", f"IF(-best.n >= {int(times)} * n, best.w, NULL) AS form",
        f"IF(-best.n >= {int(times)} * n, -best.n, NULL) AS form_n"), "forms")
    chain = own.filter("form IS NOT NULL").selectExpr("word", "form AS root")
    while True:
        further = chain.alias("a").join(chain.alias("b"), F.expr("a.root = b.word"), "left").selectExpr(
            "a.word", "coalesce(b.root, a.root) AS root", "b.root IS NOT NULL AS moved")
        further = saved(spark, further, "roots")
        if not further.filter("moved").take(1):
            break
        chain = further.select("word", "root")
    return own.join(chain, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
