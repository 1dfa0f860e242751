import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from carelens.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.RankBPE(PATH)


def test_pattern_is_the_given_one():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_digests_and_round_trip(spark, frame, docs_rows, edge_rows, library):
    rows = [(i, *r[1:]) for i, r in enumerate(docs_rows + edge_rows)]
    docs = frame(rows)
    got = {r["doc_id"]: r for r in byte_bpe.codec_digests(docs, PATH).collect()}
    tokens = byte_bpe.encoded(docs, PATH)
    ids_of = {r["doc_id"]: (r["ids"], r["offsets"]) for r in tokens.collect()}
    back = {r["doc_id"]: r for r in byte_bpe.decoded(tokens, PATH).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        text = text or ""
        ids = library.encode_ordinary(text)
        raw, offsets = library.decode_with_offsets(ids) if text.isascii() else (None, None)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert ids_of[i][0] == ids and back[i]["text"] == text and bytes(back[i]["data"]) == text.encode()
        if raw is not None:
            assert ids_of[i][1] == offsets
    assert byte_bpe.codec_digests(frame([]), PATH).count() == 0


def test_null_id_and_unknown_ids(spark, frame):
    rows = byte_bpe.codec_digests(frame([(None, "a b", None, None, None)]), PATH).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(None, 2)]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, 60_000, -4, None, 6])], "doc_id long, ids array<int>")
    c = byte_bpe.RankBPE(PATH)
    assert [bytes(r["data"]) for r in byte_bpe.decoded(odd, PATH).orderBy("doc_id").collect()] == [
        b"", b"", c.decode(np.asarray([5, 6]))]


def test_excerpts(spark, frame):
    text = "It's a naïve  example, isn't it? " * 40
    tokens = byte_bpe.encoded(frame([(1, text, None, None, None)]), PATH).selectExpr("*", "explode(sequence(0, 60, 7)) AS a").selectExpr("*", "a + 23 AS b")
    got = byte_bpe.excerpts(tokens, PATH, "a", "b").collect()
    raw = text.encode()
    assert sorted(bytes(r["data"]) for r in got) == sorted(raw[a:a + 23] for a in range(0, 61, 7))


TRICKY = st.lists(st.sampled_from(list("ab'stre vmld \n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0 ​　é漢字🙂1²٣.,!-_<|>ſK") + ["<|endoftext|>", "  ", "'ll", "'re"]), max_size=80).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(TRICKY, st.text(max_size=40)), max_size=4))
def test_like_the_library(own, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, begins = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == "".join(texts).encode()


@settings(max_examples=300, deadline=None)
@given(TRICKY, st.integers(1, 9), st.integers(1, 30))
def test_boundaries_like_the_pattern(own, text, block, part):
    before = byte_bpe.BLOCK, byte_bpe.PART
    byte_bpe.BLOCK, byte_bpe.PART = block, part  # many blocks and parts in a short text
    try:
        points = np.frombuffer(text.encode("utf-32-le") + byte_bpe.STOP_POINT.to_bytes(4, "little"), "<u4")
        got = byte_bpe.boundaries(own.classes[points]).tolist()
    finally:
        byte_bpe.BLOCK, byte_bpe.PART = before
    assert got == [m.start() for m in regex.finditer(byte_bpe.PATTERN, text)] + [len(text)]


def test_long_pre_tokens_and_small_cache(library):
    small = byte_bpe.RankBPE(PATH, cached=3)
    for text in ("a" * 20_000, "1234567890" * 3000, "abcd" * 500 + "!" * 300, "one two three four five six seven eight nine " * 5):
        assert small.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert len(small.new) <= 3 and len(small.old) <= 3
