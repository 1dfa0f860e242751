"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides spans.

Base patterns (e-mail, IP, card, phone) always stand. Wider patterns give further candidates:
bracketed "at" addresses, dotted quads and digit runs that fail a check, phone numbers without
a plus. Five labelers vote on every candidate (yes, no, or nothing): the strict pattern with its
checksum, gazetteers (top-level domains, card issuers, calling codes, reserved networks),
context words, shape, and digit variety. Expectation-maximisation over the vote patterns of the
whole corpus estimates each labeler's reliability for each kind, without labels; the resulting
probabilities train a logistic span classifier on the votes and further traits of a span.
Candidates that reach ``threshold`` and overlap no other span are added.

Tasks count the patterns (a few thousand combinations at most, whatever the corpus), so only
those counts reach the driver.

Texts go to the tasks a few megabytes at a time, however long they are. All scans take time in proportion to the text. Defined cases: NULL and empty texts have no
spans; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import column, kept_by, small_batches, text_slices

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r" ?[(\[]at[)\]] ?", re.IGNORECASE)
SPELLED = re.compile(r"[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", re.IGNORECASE)
NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
NOT_DIGIT = re.compile(r"[^0-9]")
HAS_DIGIT = re.compile(r"[0-9]")

#: Gazetteers and context words (English, German, French, Spanish).
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co me app dev de fr es uk eu us ca ch at it nl be pt mx ar jp cn in br au".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "60", "62", "64", "65", "35")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52",
           "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94",
           "95", "98", "212", "213", "216", "218", "220", "221", "234", "254", "351", "352", "353", "354", "358", "359", "370", "371", "372",
           "380", "385", "386", "420", "421", "966", "971", "972")
HINTS = {
    "email": frozenset("email mail e-mail contact write reach kontakt courriel correo contacto schreiben".split()),
    "ip": frozenset("ip server host login address from serveur adresse servidor".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta paid".split()),
    "phone": frozenset("phone tel call mobile cell fax sms whatsapp telefon anruf handy appelez portable llamar movil".split()),
}
AGAINST = frozenset("version section isbn order id ref sha hash key token serial number nr sku part build port figure table".split())


def base_emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def dotted_quads(text: str) -> list[tuple[int, int]]:
    """Every four parts of a dotted chain of numbers, from its left end."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            n = sum(map(len, parts[i:i + 4])) + 3
            out.append((at, at + n))
            at += n + 1
    return out


def is_ip(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def candidates(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """(start, end, whether the base pattern holds) by kind, in order of start."""
    out: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [(a, b, True) for a, b in base_emails(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        last = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            d = SPELLED.match(text, m.end()) if start < m.start() else None
            last = m.end()
            if d:
                out["email"].append((start, d.end(), False))
                last = d.end()
        out["email"].sort()
    if not HAS_DIGIT.search(text):
        return out
    out["ip"] = [(a, b, is_ip(text[a:b])) for a, b in dotted_quads(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19:
                out["card"].append((m.start(), m.end(), luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = len(NOT_DIGIT.sub("", m.group()))
            if 9 <= n <= 15:
                out["phone"].append((m.start(), m.end(), True))
    taken = Covered([x for k in KINDS for x in out[k] if x[2]])
    for m in NATIONAL.finditer(text):
        if not taken.meets(m.start(), m.end()):
            out["phone"].append((m.start(), m.end(), False))
    out["phone"].sort()
    return out


class Covered:
    """The union of spans; says in logarithmic time whether another span meets it."""

    def __init__(self, spans: list[tuple]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, *_ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)  # those before i begin before the span's end, and ends rise with starts
        return i > 0 and self.ends[i - 1] > start


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The five labelers' votes: 1 personal, -1 not, 0 none."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    # A failed checksum speaks against a span; an unusual spelling says nothing.
    strict = 1 if base else 0 if kind in ("email", "phone") else -1
    if kind == "email":
        tail = re.split(r"[.\])( ]", span)[-1].lower()
        listed = 1 if tail in TOP_LEVEL else -1
        shape = 1 if any(c.isalpha() for c in span.split("@")[0]) else 0
    elif kind == "ip":
        first = span.split(".")[0].lstrip("0")[:4]
        listed = -1 if first in ("", "127", "255") or len(first) > 3 or int(first) >= 224 else 1
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
    elif kind == "card":
        listed = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if len(digits) in (15, 16) and re.fullmatch(r"[0-9]+|[0-9]{4}([ -])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{4})?", span) else -1
    else:
        listed = (1 if digits.startswith(CALLING) else -1) if base else (1 if digits[0] in "23456789" else -1)
        shape = 1 if re.search(r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$", span) else 0
    before, after = text[start - 1:start], text[end:end + 1]
    if before.isalnum() or after.isalnum() or (kind != "email" and before in ("_", "/", "=", "#")):
        shape = -1
    near = re.findall(r"[a-z-]+", text[max(0, start - 40):start].lower())[-4:]
    context = 1 if HINTS[kind].intersection(near) else -1 if AGAINST.intersection(near) else 0
    variety = 0 if kind == "email" else -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" else 0
    return strict, listed, context, shape, variety


def traits(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Further discrete traits: length class, place at a line's edge, whether it holds a blank or hyphen."""
    span = text[start:end]
    edge = int(text[start - 1:start] in ("", "\n") or text[end:end + 1] in ("", "\n"))
    length = min(7, (end - start) // 4)
    return length, edge, int(" " in span or "-" in span)


class VoteModel:
    """Labeler reliabilities by kind (from EM) and the span classifier trained on them."""

    def __init__(self, patterns: dict[tuple, int], rounds: int = 100):
        self.reliability: dict[str, tuple[float, np.ndarray]] = {}
        rows, target, weight = [], [], []
        for kind in KINDS:
            own = [(p, n) for p, n in sorted(patterns.items()) if p[0] == kind]
            if not own:
                continue
            v = np.asarray([p[1] for p, _ in own])
            n = np.asarray([c for _, c in own], np.float64)
            prior, table, y = self._estimate(v, n, rounds)
            self.reliability[kind] = (prior, table)
            rows += [self._x(*p) for p, _ in own]
            target += y.tolist()
            weight += n.tolist()
        self.weights = self._train(np.asarray(rows), np.asarray(target), np.asarray(weight)) if rows else None

    @staticmethod
    def _estimate(v: np.ndarray, n: np.ndarray, rounds: int):
        """EM for a latent yes/no with votes independent given it; Dirichlet(1) smoothed tables."""
        y = 1 / (1 + np.exp(-(2.0 * v[:, 0] + v[:, 1:].sum(1))))
        prior, table = 0.5, np.zeros((2, v.shape[1], 3))
        for _ in range(rounds):
            for c, share in ((0, 1 - y), (1, y)):
                for j in range(v.shape[1]):
                    counts = np.bincount(v[:, j] + 1, share * n, 3) + 1
                    table[c, j] = counts / counts.sum()
            prior = float((y * n).sum() + 1) / float(n.sum() + 2)
            logs = [np.log(table[c, np.arange(v.shape[1]), v + 1]).sum(1) for c in (0, 1)]
            z = np.log(prior / (1 - prior)) + logs[1] - logs[0]
            new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if np.abs(new - y).max() < 1e-6:
                y = new
                break
            y = new
        return prior, table, y

    @staticmethod
    def _x(kind: str, v: tuple[int, ...], t: tuple[int, ...]) -> np.ndarray:
        x = np.zeros(len(KINDS) * (1 + 3 * len(v)) + 8 + 2)
        at = KINDS.index(kind) * (1 + 3 * len(v))
        x[at] = 1
        x[at + 1 + 3 * np.arange(len(v)) + np.asarray(v) + 1] = 1
        x[len(KINDS) * (1 + 3 * len(v)) + t[0]] = 1
        x[-2:] = t[1:]
        return x

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
        """Weighted logistic regression on soft labels (Newton's method)."""
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def probability(self, kind: str, v: tuple[int, ...], t: tuple[int, ...]) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self._x(kind, v, t) @ self.weights, -30, 30))))


def pattern_counts(docs: DataFrame) -> dict[tuple, int]:
    """How often each (kind, votes, traits) occurs among all candidates of ``docs`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("personal_data")
        held: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    for kind, spans in candidates(t).items():
                        held.update([(kind, votes(kind, t, a, b, base), traits(kind, t, a, b)) for a, b, base in spans])
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
             pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), pa.array([held[k] for k in keys], pa.int64())],
            ["kind", "votes", "traits", "n"])

    counts = docs.select("text").mapInArrow(run, "kind string, votes array<int>, traits array<int>, n long").groupBy(
        "kind", "votes", "traits").agg(F.sum("n").alias("n"))
    return {(r["kind"], tuple(r["votes"]), tuple(r["traits"])): r["n"] for r in counts.collect()}  # bounded combinations


class SpanFinder:
    """All spans of a text under a model."""

    def __init__(self, model: VoteModel, threshold: float = THRESHOLD):
        self.model, self.threshold = model, threshold
        self.known: dict[tuple, bool] = {}

    def spans(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
        """(base spans, all spans) by kind."""
        found = candidates(text)
        base = {k: [(a, b) for a, b, ok in found[k] if ok] for k in KINDS}
        if all(ok for k in KINDS for _, _, ok in found[k]):
            return base, base
        every = {k: list(v) for k, v in base.items()}
        taken = [s for v in base.values() for s in v]
        for k in KINDS:
            covered, last = Covered(taken), -1  # candidates of a kind are in order of start
            for a, b, ok in found[k]:
                if not ok and a >= last and not covered.meets(a, b):
                    p = (k, votes(k, text, a, b, ok), traits(k, text, a, b))
                    if p not in self.known:
                        self.known[p] = self.model.probability(*p) >= self.threshold
                    if self.known[p]:
                        every[k].append((a, b))
                        taken.append((a, b))
                        last = max(last, b)
            every[k].sort()
        return base, every


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps become one."""
    flat = sorted((a, b, k) for k, v in spans.items() for a, b in v)
    out, at = [], 0
    for a, b, k in flat:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def learned(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> SpanFinder:
    small_batches(spark)
    return SpanFinder(VoteModel(pattern_counts(docs)), threshold)


def personal_data(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for ``docs`` (doc_id, text)."""
    shared = spark.sparkContext.broadcast(learned(spark, docs, threshold))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("personal_data")
        finder = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                found = [finder.spans(t) for t in texts]
                counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), *counts, pa.array(digests, pa.string()), pa.array([joined(every) for _, every in found], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(spark: SparkSession, docs: DataFrame, finder: SpanFinder) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; NULL texts stay NULL; other columns as they are."""
    shared = small_batches(spark).sparkContext.broadcast(finder)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("personal_data")
        f = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                valid = column(part, "text").is_valid().to_pylist()
                new = [redact(t, f.spans(t)[1]) if ok else None for t, ok in zip(texts, valid)]
                at = names.index("text")
                cols = [pa.array(new, part.schema.field(at).type) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
