import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carelens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, window=2048):
    """Every id in one piece, sequences gapless and not too long; returns the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.asarray(ids[at:at + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    total = padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and all(r["sequence_tokens"] == at for r in pieces)
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_documents(spark, frame, docs_rows, library):
    rows = packing.packed_pieces(frame(docs_rows).repartition(3), PATH).collect()
    assert check(rows, {r[0]: r[1] for r in docs_rows}, library) < 0.01


def test_edges(spark, frame, edge_rows, library):
    unique = {r[0]: r[1] for r in edge_rows}
    rows = packing.packed_pieces(frame([r for i, r in enumerate(edge_rows) if i != 5]).coalesce(1), PATH, buffer_ids=3000).collect()
    check(rows, unique, library)
    both = packing.packed_pieces(frame([edge_rows[4], edge_rows[5]]).coalesce(1), PATH).collect()
    assert sum(r["length"] for r in both) == 12 and len({(r["sequence_id"], r["offset"]) for r in both}) == len(both)
    assert packing.packed_pieces(frame([]), PATH).count() == 0


def test_ids_are_returned(spark, frame, docs_rows, library):
    rows = packing.packed_pieces(frame(docs_rows[:20]), PATH, window=64, with_ids=True).collect()
    texts = {r[0]: r[1] for r in docs_rows[:20]}
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert r["ids"] == ids[r["start"]:r["start"] + r["length"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_is_tightest(lengths):
    """Against a plain search for the tightest open window."""
    window = 40
    capacities, expect = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [c for c in capacities if c >= lengths[i]]
        if fits:
            capacities.remove(min(fits))
            capacities.append(min(fits) - lengths[i])
        else:
            capacities.append(window - lengths[i])
    got = packing.best_fit_decreasing(np.asarray(lengths, np.int64), window)
    assert sorted(i for w in got for i in w) == list(range(len(lengths)))
    assert sorted(window - sum(lengths[i] for i in w) for w in got) == sorted(capacities)


TRICKY = st.lists(st.sampled_from(list("abZ'stre  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u0301\u030aÅéßİς漢字🙂1²٣.,!-_<|>*\x00\u200d") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "Ab.,", "x9!!", "\u0958.", "\ufb2e!"]), max_size=60).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(TRICKY, st.text(max_size=30)), min_size=1, max_size=4))
def test_ids_like_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = packing.word_ids(PATH).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_caches_are_bounded(library):
    small = packing.WordIds(PATH, budget=4000)
    for text in ("one two three four five six", "Seven, eight. nine ten! eleven 12 13", "x" * 900 + " one", " ".join(f"w{i}" for i in range(500))):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    own = packing.WordIds(PATH, budget=200_000)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(200))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for cache, room in ((own.words, own.word_room), (own.parts, own.part_room)):
        assert 0 < sum(room.ENTRY + len(k) + len(v) for k, v in cache.items()) < 2 * room.budget


def test_other_tokenizers_encode_whole_texts(tmp_path, library):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.by_words(spec)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]  # case is not folded
    assert not packing.by_words(spec)
    own = tmp_path / "cased.json"
    own.write_text(json.dumps(spec))
    text = "Hello World, it's  A Test"
    got = np.frombuffer(packing.WordIds(str(own)).encode([text])[0], "<u4").tolist()
    assert got == Tokenizer.from_file(str(own)).encode(text, add_special_tokens=False).ids != library.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_the_caches_of_one_step():
    import weakref

    from carelens.llm import common
    encoder = packing.word_ids(PATH)
    assert packing.word_ids(PATH) is encoder
    gone = weakref.ref(encoder)
    del encoder
    common.kept_by("personal_data")
    assert gone() is None
