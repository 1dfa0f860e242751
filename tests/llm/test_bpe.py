import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(PATH)


def test_digests(spark, frame, docs_rows, edge_rows, library):
    rows = [r for r in docs_rows + edge_rows if r[0] is not None]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in bpe.codec_digests(frame(rows), PATH).collect()}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]]["n_tokens"] == len(ids)
        assert got[r[0]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r[0]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.codec_digests(frame([]), PATH).count() == 0


def test_round_trip_operators(spark, frame, docs_rows):
    docs = frame(docs_rows[:30])
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}
    assert back == {r[0]: r[1] for r in docs_rows[:30]}


TRICKY = st.lists(st.sampled_from(list("ab'stre vmld \n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0 ​　é漢字🙂1²٣.,!-_<|>") + ["<|endoftext|>", "  ", "'ll"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TRICKY, st.text(max_size=40)))
def test_like_the_library(own, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_limit(library):
    small = bpe.ByteBPE(PATH, cache_limit=10)
    for text in ("one two three four five six seven", "eight nine ten " * 9, "x" * 500 + " y"):
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(small.cache) < 20
