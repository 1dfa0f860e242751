import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = {"email": EMAIL.finditer(text), "ip": (m for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))),
             "card": (m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             "phone": (m for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15)}
    return {k: [(m.start(), m.end()) for m in v] for k, v in spans.items()}


PARTS = st.lists(st.sampled_from(["a", "Bc", "@", "@x.y", ".", "..", "1", "255", "256", "007", "4539578763621486", "4539 5787 6362 1486", "-", " ", "+",
                                  "+49 (0)30 1234567", "(", ")", "é", "\n", "12.13.14.15", "%", "(at)", "555-123-4567", "_"]), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(PARTS)
def test_base_spans_like_the_patterns(text):
    found = P.candidates(text)
    assert {k: [(a, b) for a, b, ok in found[k] if ok] for k in P.KINDS} == brute(text)


def test_documents(spark, frame, docs_rows, edge_rows):
    rows = docs_rows + edge_rows[:9] + [(900, "mail a.b@c.de or 1.2.3.4, card 4539 5787 6362 1486, +1 (212) 555-0123", "en", "s", 1)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in P.personal_data(spark, frame(rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = brute(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k in P.KINDS for a, b in base[k])
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [len(base[k]) for k in P.KINDS]
        assert set(filter(None, said.split(","))) <= set(got[i]["spans"].split(","))
    assert P.personal_data(spark, frame([])).count() == 0


def test_the_model_adds_spans_with_support(spark, frame):
    """Phones without a plus, after a context word, are added; failed card numbers are not."""
    rows = [(i, f"Call phone (212) 555-0{100 + i} or +1 (212) 555-0{100 + i} now. Order 4539578763621487 sku.", "en", "s", 1) for i in range(300)]
    got = P.personal_data(spark, frame(rows)).collect()
    assert all(r["spans"].count("phone:") == 2 and "card" not in r["spans"] for r in got)


def test_redaction_keeps_the_rest(spark, frame):
    rows = [(1, "x a.b@c.de y 1.2.3.4", "en", "s", 20), (2, None, "en", "s", None), (3, "clean", "en", "s", 5)]
    docs = frame(rows)
    got = {r["doc_id"]: r for r in P.redacted(spark, docs, P.learned(spark, docs)).collect()}
    assert got[1]["text"] == "x <EMAIL> y <IP>" and got[2]["text"] is None and got[3]["text"] == "clean" and got[1]["score"] == "x"


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+" * 300_000, "+1" + " " * 300_000, "@" * 100_000, "1 " * 100_000):
        P.candidates(text)


def plain_overlaps(a, b, spans):
    return any(s[0] < b and a < s[1] for s in spans)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)).map(lambda x: (x[0], x[0] + x[1])), max_size=12), st.integers(0, 45), st.integers(1, 9))
def test_covered_like_a_plain_search(spans, a, n):
    assert P.Covered(spans).meets(a, a + n) == plain_overlaps(a, a + n, spans)


class Says:
    """A model that adds what has an even number of characters (by a hash of the votes elsewhere)."""

    def probability(self, kind, v, t):
        return (hash((kind, v, t)) % 3) / 2


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_added_spans_like_a_plain_search(text):
    """Candidates in order of kind and start join unless they meet a base span or one that joined before."""
    found = P.candidates(text)
    base = {k: [(a, b) for a, b, ok in found[k] if ok] for k in P.KINDS}
    want, taken = {k: list(v) for k, v in base.items()}, [s for v in base.values() for s in v]
    model = Says()
    for k in P.KINDS:
        for a, b, ok in found[k]:
            if not ok and not plain_overlaps(a, b, taken) and model.probability(k, P.votes(k, text, a, b, ok), P.traits(k, text, a, b)) >= 0.5:
                want[k].append((a, b))
                taken.append((a, b))
    assert P.SpanFinder(model, 0.5).spans(text) == (base, {k: sorted(v) for k, v in want.items()})


def test_many_spans_take_linear_time():
    import time
    text = "call 212 555 0143 or +1 212 555 0199 " * 60_000  # 2.2 MB, 120,000 spans
    start = time.perf_counter()
    base, every = P.SpanFinder(Says(), -1).spans(text)
    assert len(base["phone"]) == 60_000 and len(every["phone"]) == 120_000
    assert time.perf_counter() - start < 30


def test_texts_reach_the_tasks_in_small_batches(spark, frame):
    """Rows of 100 KB do not meet in one batch of a partition; results and order stay."""
    import pyarrow as pa
    rows = [(i, f"mail a{i}@c.de " + "x" * 100_000, "en", "s", 1) for i in range(100)]
    docs = frame(rows).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    for step in (lambda: P.redacted(spark, docs, P.SpanFinder(P.VoteModel({}))), lambda: P.personal_data(spark, docs)):
        spark.conf.unset(limit)
        out = step()
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 100 and max(r["bytes"] for r in got) < 4 << 20
        if "text" in out.columns:
            assert [r["text"] for r in out.collect()] == [t.replace(f"a{i}@c.de", "<EMAIL>") for i, t, *_ in rows]
        else:
            assert out.agg({"n_email": "sum"}).first()[0] == 100
    spark.conf.set(limit, "8m")
    P.redacted(spark, docs, P.SpanFinder(P.VoteModel({})))
    assert spark.conf.get(limit) == "8m"
    spark.conf.unset(limit)
