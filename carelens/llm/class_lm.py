"""Scoring texts with a Brown class-based bigram model and a unigram baseline.

Exchange clustering seeds the classes with the most frequent words: words move, one after another,
to the class that most raises the likelihood of the class bigrams, until none moves. Every further
word seen LEAST times then takes the class that most raises the likelihood, by the counts of the
classes beside it in all learning texts; the dictionary's words choose again until few move. Words
seen less often form one open class; the text end is a class of its own. A token's probability is
that of its class after the class before it, times that of the word in its class, both with
add-one smoothing.

Counts cover all learning texts. Words that hold more than 1 / ``dictionary`` of all tokens are
at most ``dictionary`` many, so they are broadcast whatever the corpus; the other words of a text
(each rare, so none is a hot key) meet their counts and classes in a join.

Defined cases: a NULL or empty text is one end token; repeated rows count and are scored each;
a NULL doc_id is scored (held_out false) but not learned from; with nothing to learn from all
counts are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, in_fold, saved, text_slices

#: No word holds white space, so this stands for the text end.
END = b"\n"
DICTIONARY = 1 << 21
#: Seeds of the classes; all other words seen LEAST times follow.
CLASS_WORDS = 800
CLASSES = 48
LEAST = 5
FEW = 0.05
#: Tokens whose neighbour counts a task adds up before they are shuffled.
NEIGHBOURS = 1 << 22


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n over the texts and their ends of ``docs`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    held.update(tokens(t))
                held[END] += len(texts)
                if len(held) > 800_000:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def coded_texts(docs: DataFrame, learn: Column, held_out: Column, words: list[bytes], log_count: np.ndarray) -> DataFrame:
    """Texts of ``docs`` (doc_id, text) as numbers: i for ``words[i]``, len(words) + 2 + j for the text's j-th other word.

    key, doc_id, held_out, learn, n_tokens, known, logs, seq (int32 numbers, without the end), words, times.
    ``known`` and ``logs`` (sum of log counts, with the end) leave out the other words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, log_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, logs = shared.value
        first = len(index) + 2
        known_end = 1 if logs[-1] else 0
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in text_slices(batch):
                out: list[list] = [[], [], [], [], [], []]
                for t in texts:
                    own = tokens(t)
                    seq = np.fromiter(map(index.get, own, repeat(-1)), np.int32, len(own))
                    at = np.flatnonzero(seq < 0)
                    rare = [own[i] for i in at.tolist()]
                    number = {w: j for j, w in enumerate(dict.fromkeys(rare))}
                    total = float(logs[seq].sum()) - float(logs[-1]) * (len(at) - 1)  # -1 reads the end's
                    seq[at] = [first + number[w] for w in rare]
                    times = Counter(rare)
                    for kept, x in zip(out, (len(own) + 1, len(own) - len(at) + known_end, total, seq.tobytes(), list(number),
                                             [times[w] for w in number])):
                        kept.append(x)
                keys = range(key, key + len(texts))
                key += len(texts)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), *(column(part, c) for c in ("doc_id", "held_out", "learn")),
                     *map(pa.array, out, kinds)],
                    ["key", "doc_id", "held_out", "learn", "n_tokens", "known", "logs", "seq", "words", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), learn.alias("learn"), "text")
    return saved(docs.sparkSession, rows.mapInArrow(
        run, "key long, doc_id long, held_out boolean, learn boolean, n_tokens long, known long, logs double, seq binary, "
             "words array<binary>, times array<int>"), "coded")


def _pieces(batch: pa.RecordBatch, name: str, kind: str, limit: int = 1 << 19) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(start, stop, number arrays) of rows of a batch with about ``limit`` numbers together (one row at least)."""
    start, size, held = 0, 0, []
    for i, x in enumerate(column(batch, name).to_pylist()):
        x = np.frombuffer(x, kind)
        if held and size + len(x) > limit:
            yield start, i, held
            start, size, held = i, 0, []
        held.append(x)
        size += len(x) + 1
    if held:
        yield start, start + len(held), held


def _joined(texts: list[np.ndarray], end: int) -> np.ndarray:
    """The texts in a row, the end before the first and after each."""
    stop = np.asarray([end], np.int64)
    return np.concatenate([stop, *(x for t in texts for x in (t, stop))])


def pair_table(rows: DataFrame, name: str, kind: str, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of class pairs in the texts (numbers ``name``), by the class of each number.

    The last two of ``of`` are the class of any further number and that of the end.
    """
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, texts in _pieces(batch, name, kind):
                s = _joined(texts, len(cls) - 1)
                s = cls[np.where(s >= len(cls), len(cls) - 2, s)].astype(np.int64)
                total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    found = rows.select(name).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)  # at most size * size rows
    return out.reshape(size, size)


def neighbour_classes(coded: DataFrame, of: np.ndarray, size: int, first: int, stop: int) -> DataFrame:
    """word, cells, times: how often a class stands after (cell k) and before (cell size + k) each word.

    Words are the numbers from ``first`` up to ``stop``; with ``first`` beyond the dictionary, the other words
    themselves. A neighbour outside the dictionary counts by the open class. Each piece of the texts has a row of a word;
    cells and times are packed numbers.
    """
    shared = coded.sparkSession.sparkContext.broadcast(of)
    rare = first >= len(of)
    kind = np.min_scalar_type(2 * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        for batch in batches:
            others = column(batch, "words").to_pylist() if rare else []
            for start, end, texts in _pieces(batch, "seq", "<i4", NEIGHBOURS):
                numbers: dict[bytes, int] = {}
                if rare:
                    moved = []
                    for t, own in zip(texts, others[start:end]):
                        ids = np.asarray([numbers.setdefault(w, len(numbers)) for w in own], np.int64)
                        t = t.astype(np.int64)
                        at = t >= len(cls)
                        t[at] = len(cls) + ids[t[at] - len(cls)]
                        moved.append(t)
                    texts = moved
                s = _joined(texts, len(cls) - 1)
                c = cls[np.where(s >= len(cls), len(cls) - 2, s)].astype(np.int64)
                at = np.flatnonzero((s >= first) & (s < stop) & (s != len(cls) - 1))
                pair, n = np.unique(np.concatenate((s[at] * (2 * size) + c[at + 1], s[at] * (2 * size) + size + c[at - 1])),
                                    return_counts=True)
                word, cell = pair // (2 * size), pair % (2 * size)
                key = word[np.diff(word, prepend=-1) > 0]
                parts = -(-n // 255)  # a byte each: larger counts take several cells
                word, cell = np.repeat(word, parts), np.repeat(cell, parts)
                times = np.full(len(word), 255, np.uint8)
                times[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
                at = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word)).astype(np.int32)
                lists = []
                for values in (cell.astype(kind), times):
                    offsets = at * np.int32(values.itemsize)
                    lists.append(pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
                if rare:
                    named = list(numbers)
                    key = pa.array([named[i] for i in (key - len(cls)).tolist()], pa.binary())
                else:
                    key = pa.array(key, pa.int64())
                yield pa.RecordBatch.from_arrays([key, *lists], ["word", "cells", "times"])

    return coded.select("seq", "words").mapInArrow(run, f"word {'binary' if rare else 'long'}, cells binary, times binary")


def best_classes(found: DataFrame, kind: str, of: np.ndarray, n: np.ndarray, classes: int) -> DataFrame:
    """word, n, cls: the class that most raises the likelihood of the class pairs ``n`` for each word of ``found``.

    A word in one of the ``classes`` is first taken out of the table. Words seen less than LEAST times stay open.
    """
    size = len(n)
    packed = np.min_scalar_type(2 * size)
    shared = found.sparkSession.sparkContext.broadcast((of, n))

    def choose(part: pa.RecordBatch, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole words; ``word`` numbers the words of the rows from 0."""
        now, table = shared.value
        sides = np.concatenate((table.T, table))[:, :classes]
        names = column(part, "word").take(pa.array(np.flatnonzero(np.diff(word, prepend=-1))))
        cells = column(part, "cells").to_pylist()
        row = np.repeat(word, [len(x) // packed.itemsize for x in cells])
        pair, back = np.unique(row * (2 * size) + np.frombuffer(b"".join(cells), packed), return_inverse=True)
        m = np.bincount(back, np.frombuffer(b"".join(column(part, "times").to_pylist()), np.uint8))
        row, cell = pair // (2 * size), pair % (2 * size)
        seen = np.bincount(row, m * (cell < size), len(names))
        old = np.full(len(names), classes) if kind == "binary" else now[names.to_numpy()].astype(np.int64)
        gain = np.zeros((len(names), classes))
        for i in range(0, len(row), 20_000):
            r, k = row[i:i + 20_000], m[i:i + 20_000, None]
            have = sides[cell[i:i + 20_000]] - np.where(old[r][:, None] == np.arange(classes), k, 0.0)
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            gain[r[starts]] += np.add.reduceat(_xlogx(have + k) - _xlogx(have), starts)
        k = seen[:, None]
        less = np.where(old[:, None] == np.arange(classes), k, 0.0)
        for total in (table.sum(1)[:classes], table.sum(0)[:classes]):
            gain -= _xlogx(total - less + k) - _xlogx(total - less)
        best = gain.argmax(1)
        stays = gain[np.arange(len(names)), np.minimum(old, classes - 1)] + 1e-9 * (1 + seen)
        best = np.where((old < classes) & (gain.max(1) <= stays), old, best)
        best = np.where(seen < LEAST, classes, best)
        yield pa.RecordBatch.from_arrays([names, pa.array(seen.astype(np.int64)), pa.array(best, pa.int32())], ["word", "n", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                if rest is not None:
                    part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
                names = column(part, "word")
                word = np.cumsum(np.append(0, names[1:].to_numpy(False) != names[:-1].to_numpy(False)))
                cut = int(np.searchsorted(word, word[-1]))  # the last word may go on
                if cut:
                    yield from choose(part.slice(0, cut), word[:cut])
                rest = part.slice(cut)
        if rest is not None:
            yield from choose(rest, np.zeros(rest.num_rows, np.int64))

    # A given number of partitions, so that adaptive execution leaves the rows of a word together.
    dealt = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return dealt.sortWithinPartitions("word").mapInArrow(run, f"word {kind}, n long, cls int")


def likelihood(n: np.ndarray) -> float:
    """Log likelihood of the class pairs but for what no class changes."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum())


def clustered(learning: DataFrame, model: ClassModel) -> None:
    """Give every dictionary word seen LEAST times its class; classes of the seed words stay.

    All words choose against the same table, again and again, until at most FEW of their tokens move or the
    likelihood no longer rises.
    """
    classes, size = model.open, model.end + 1
    stop = int((model.counts >= LEAST).sum())
    if stop <= model.seeds:
        return
    of, counts = model.cls, model.counts
    n = pair_table(learning, "seq", "<i4", of, size)
    while True:
        found = best_classes(neighbour_classes(learning, of, size, model.seeds, stop), "long", of, n, classes).toPandas()
        new = of.copy()
        new[found["word"].to_numpy(np.int64)] = found["cls"].to_numpy(np.int64)
        table = pair_table(learning, "seq", "<i4", new, size)
        if likelihood(table) <= likelihood(n):
            break
        moved = counts[model.seeds:stop][(new != of)[model.seeds:stop]].sum() / counts[model.seeds:stop].sum()
        of, n = new, table
        if moved <= FEW:
            break
    model.cls = of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_clustering(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Class of every symbol of a bigram table whose last two symbols keep classes of their own.

    Words move until none gains; a gain within the rounding of the sums is none.
    """
    words = len(bigrams) - 2
    classes = max(1, min(classes, words))
    of = np.concatenate((np.arange(words) % classes, [classes, classes + 1]))
    size = classes + 2
    member = np.zeros((len(of), size))
    member[np.arange(len(of)), of] = 1
    n = member.T @ bigrams @ member
    out_sum, in_sum = n.sum(1), n.sum(0)
    least = 1e-9 * max(1.0, float(bigrams.sum()))
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            own = bigrams[w, w]
            r = np.bincount(of, bigrams[w], size)
            c = np.bincount(of, bigrams[:, w], size)
            a = of[w]
            r[a] -= own
            c[a] -= own
            n[a] -= r
            n[:, a] -= c
            n[a, a] -= own
            out_w, in_w = r.sum() + own, c.sum() + own
            out_sum[a] -= out_w
            in_sum[a] -= in_w
            # Row b gains r, column b gains c, and the cell (b, b) both and the word's own pairs.
            base = _xlogx(n)
            gain = (_xlogx(n + r[None, :]) - base).sum(1) + (_xlogx(n + c[:, None]) - base).sum(0)
            d = np.diagonal(n)
            gain += _xlogx(d + r + c + own) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
            gain -= _xlogx(out_sum + out_w) - _xlogx(out_sum) + _xlogx(in_sum + in_w) - _xlogx(in_sum)
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + least:
                b = a
            moved += b != a
            of[w] = b
            n[b] += r
            n[:, b] += c
            n[b, b] += own
            out_sum[b] += out_w
            in_sum[b] += in_w
    return of


class ClassModel:
    """Dictionary words with their log10 counts, classes and emissions, and class transitions.

    Starts with classes for the words of ``vocabulary`` (seeds) alone.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], tokens_: int, distinct: int, vocabulary: list[bytes],
                 bigrams: np.ndarray, classes: int):
        of = exchange_clustering(bigrams, classes)
        self.open, self.end = int(of[-2]), int(of[-1])
        size = self.end + 1
        member = np.zeros((len(of), size))
        member[np.arange(len(of)), of] = 1
        count = dict(frequent)
        self.ends = count.get(END, 0)
        self.tokens, self.distinct, self.seeds = tokens_, distinct, len(vocabulary)
        self.base = math.log10(tokens_ + distinct + 1)
        words = [(w, c) for w, c in frequent if w != END]
        self.index = {w: i for i, (w, _) in enumerate(words)}
        self.counts = np.asarray([c for _, c in words], np.int64)
        # Last: any other word (0, its count follows), the end.
        self.log_count = np.log10(np.append(self.counts + 1, [1, self.ends + 1]).astype(np.float64))
        class_of = dict(zip(vocabulary, of.tolist()))
        self.cls = np.asarray([class_of.get(w, self.open) for w, _ in words] + [self.open, self.end], np.int64)
        self.settle(member.T @ bigrams @ member)

    def settle(self, n: np.ndarray, more_total: np.ndarray | None = None, more_words: np.ndarray | None = None) -> None:
        """Transitions from the class pairs ``n``, emissions by class; ``more_``: of words outside the dictionary in a class."""
        size = self.end + 1
        self.transition = np.log10((n + 1) / (n.sum(1, keepdims=True) + size))
        own = self.cls[:-2]
        total = np.bincount(own, self.counts, size) + (0 if more_total is None else more_total)
        words = np.bincount(own, minlength=size) + (0 if more_words is None else more_words)
        closed = np.arange(size) < self.open
        total[self.open] = self.tokens - self.ends - total[closed].sum()
        words[self.open] = self.distinct - (1 if self.ends else 0) - words[closed].sum() + 1
        self.class_base = np.log10(np.maximum(total + words, 1))
        self.class_base[self.end] = self.log_count[-1]
        self.open_base = float(self.class_base[self.open])
        self.emission = self.log_count - self.class_base[self.cls]


def learned(spark: SparkSession, docs: DataFrame, modulus: int, remainder: int, dictionary: int = DICTIONARY,
            class_words: int = CLASS_WORDS, classes: int = CLASSES) -> tuple[ClassModel, DataFrame, DataFrame]:
    """(model with the dictionary's classes, word, n, cls of all other words, coded texts) of ``docs`` (doc_id, text)."""
    fold = in_fold("doc_id", modulus, remainder)
    counts = saved(spark, word_counts(docs.filter(~fold)), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("n") * dictionary >= total
    # At most ``dictionary`` rows, as their shares of the tokens sum to 1 at most.
    frequent = sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(often | (F.col("word") == END)).toLocalIterator()),
                      key=lambda r: (-r[1], r[0]))
    words = [(w, c) for w, c in frequent if w != END]
    ends = dict(frequent).get(END, 0)
    logs = np.log10(np.asarray([c + 1 for _, c in words] + [1, ends + 1], np.float64))
    coded = coded_texts(docs, F.coalesce(~fold, F.lit(False)), F.coalesce(fold, F.lit(False)), [w for w, _ in words], logs)
    learning = coded.filter("learn")
    vocabulary = [w for w, _ in words][:class_words]
    seeds = len(vocabulary)
    first = np.minimum(np.arange(len(words) + 2), seeds)
    first[-1] = seeds + 1
    model = ClassModel(frequent, total, distinct, vocabulary, pair_table(learning, "seq", "<i4", first, seeds + 2), classes)
    clustered(learning, model)
    size = model.end + 1
    n = pair_table(learning, "seq", "<i4", model.cls, size)
    found = neighbour_classes(learning, model.cls, size, len(model.cls), 1 << 62)
    return model, saved(spark, best_classes(found, "binary", model.cls, n, model.open), "rare_classes"), coded


def lm_scores(spark: SparkSession, docs: DataFrame, modulus: int = 7, remainder: int = 2, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for ``docs`` (doc_id, text)."""
    model, rare_classes, coded = learned(spark, docs, modulus, remainder, **settings)
    size = model.end + 1
    kind = np.min_scalar_type(size).str
    shared = spark.sparkContext.broadcast(model.cls)

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class of each number, ``size`` for other words, whose numbers in the text follow in ``rest``."""
        cls = np.append(shared.value, size).astype(kind)
        for batch in batches:
            out, rest = [], []
            for x in column(batch, "seq").to_pylist():
                s = np.frombuffer(x, "<i4")
                out.append(cls[np.minimum(s, len(cls) - 1)].tobytes())
                rest.append((s[s >= len(cls) - 1] - (len(cls) - 1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in plain), pa.array(out, pa.binary()), pa.array(rest, pa.binary())], [*plain, "cls", "rest"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, rest, at, own in zip(*(column(batch, c).to_pylist() for c in ("cls", "rest", "at", "own"))):
                s, rest = np.frombuffer(x, kind).copy(), np.frombuffer(rest, "<i4")
                if len(rest):
                    known = np.full(int(rest.max()) + 1, model_open)
                    known[at or []] = own or []
                    s[s == size] = known[rest]
                out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in (*plain[1:], "more_known", "more")), pa.array(out, pa.binary())],
                                             [*plain[1:], "more_known", "more", "cls"])

    model_open = model.open
    plain = ["key", "doc_id", "held_out", "learn", "n_tokens", "known", "logs"]
    types = "doc_id long, held_out boolean, learn boolean, n_tokens long, known long, logs double"
    rare = coded.select("key", F.posexplode(F.arrays_zip("words", "times")).alias("at", "w")).select(
        "key", "at", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(rare_classes, "word").groupBy("key").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"),
        F.collect_list(F.struct("at", "cls")).alias("w")).select("key", "more_known", "more", F.col("w.at").alias("at"), F.col("w.cls").alias("own"))
    classed = coded.select(*plain, "seq").mapInArrow(classes_of, f"key long, {types}, cls binary, rest binary").join(found, "key", "left")
    classed = saved(spark, classed.mapInArrow(filled, f"{types}, more_known long, more double, cls binary"), "classed")

    n = pair_table(classed.filter("learn"), "cls", kind, np.append(np.arange(size - 1), size - 1), size)
    sums = rare_classes.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    more = np.zeros((2, size))
    for r in sums:
        more[:, r["cls"]] = r["n"], r["words"]
    model.settle(n, *more)
    step = spark.sparkContext.broadcast(model.transition - model.class_base[None, :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "known", "logs", "more_known", "more"]
        for batch in batches:
            steps = []
            for x in column(batch, "cls").to_pylist():
                s = np.frombuffer(x, kind).astype(np.int64)
                steps.append(float(step.value[np.append(size - 1, s), np.append(s, size - 1)].sum()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(steps, pa.float64())], [*names, "steps"])

    scored = classed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, logs double, more_known long, "
                                     "more double, steps double")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(model.base)).alias("base_score"), (logs + F.col("steps")).alias("score"))
