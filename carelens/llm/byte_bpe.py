"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become one array of code points, each of which has a class (letter, number, space, other
white space, apostrophe, the letters that contractions are made of, anything else, text end). The
pre-token pattern is an automaton over classes, so every character is a function from states to
states, and functions compose associatively: the array is cut into blocks, the function of each
block is composed character by character for all blocks at once, a prefix scan over the blocks
gives the state in which each one begins, and a second sweep the state before each character. State and
class say whether a pre-token begins at the character or at the one before it; no regular
expression looks at a text.

The bytes between boundaries are the keys of a cache of merged pairs. Every id keeps the byte
offset at which it begins, so that decoding can fill one buffer for many texts, or give a part
of a text alone.

Ids, decoded bytes and classes of characters are those of the tiktoken library for the same
ranks (its tables of Unicode letters, numbers and spaces are read from it once a worker).

Defined cases: NULL and empty texts have no ids and decode to nothing; strings that look like
special tokens are ordinary text; repeated rows are encoded each; NULL ids count as none, ids
outside the vocabulary decode to nothing; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carelens.llm.common import column, text_slices

#: The pre-token pattern that the automaton below recognises.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of code points. S1: the letters of one-letter contractions; R and V are followed by E, LL by itself.
OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE, S1, RV, LL, E, STOP = range(11)
#: States: what the characters so far end in. *_ONE: one white-space character, *_MORE: several; the last one a space or not.
#: MARK: an apostrophe that begins a pre-token; MARK_RV, MARK_LL: and a letter that may begin a contraction; DONE: after one.
AT_STOP, IN_OTHER, IN_LETTERS, IN_NUMBER, BLANK_ONE, WHITE_ONE, BLANK_MORE, WHITE_MORE, MARK, MARK_RV, MARK_LL, DONE = range(12)
CLASSES, STATES = 11, 12
#: Flags of a step: a pre-token begins here; one begins at the character before.
HERE, BEFORE = 1, 2
STOP_POINT = 0x110000
BLOCK = 256
#: Code points handled at a time; the state goes on from one such part to the next.
PART = 1 << 20
#: Pre-tokens longer than this are merged with a heap and not cached; entries in each half of the cache.
LONG = 64
CACHED = 150_000


def _step(state: int, cls: int) -> tuple[int, int]:
    """(next state, flags) of the automaton."""
    letter = cls in (LETTER, S1, RV, LL, E)
    flags = 0
    if state in (MARK_RV, MARK_LL):
        if cls == (E if state == MARK_RV else LL):
            return DONE, 0
        flags, state = BEFORE, IN_LETTERS  # the letter was not part of a contraction
    if cls == STOP:
        return AT_STOP, flags | HERE
    white = state in (BLANK_ONE, WHITE_ONE, BLANK_MORE, WHITE_MORE)
    if cls in (BLANK, WHITE):
        if white:
            return (BLANK_MORE if cls == BLANK else WHITE_MORE), flags
        return (BLANK_ONE if cls == BLANK else WHITE_ONE), flags | HERE
    if white:
        # Of several white-space characters the last one is left over; a space then joins what follows.
        if state in (BLANK_MORE, WHITE_MORE):
            flags |= BEFORE
        if state in (BLANK_ONE, BLANK_MORE):
            return (IN_LETTERS if letter else IN_NUMBER if cls == NUMBER else IN_OTHER), flags
        state = AT_STOP
    if letter:
        if state == MARK and cls == S1:
            return DONE, flags
        if state == MARK and cls in (RV, LL):
            return (MARK_RV if cls == RV else MARK_LL), flags
        return IN_LETTERS, flags | (0 if state == IN_LETTERS else HERE)
    if cls == NUMBER:
        return IN_NUMBER, flags | (0 if state == IN_NUMBER else HERE)
    if state in (IN_OTHER, MARK):
        return IN_OTHER, flags
    return (MARK if cls == QUOTE else IN_OTHER), flags | HERE


_TABLE = [[_step(s, c) for s in range(STATES)] for c in range(CLASSES)]
#: By class * STATES + state.
NEXT = np.asarray([[t[0] for t in row] for row in _TABLE], np.uint8).ravel()
FLAGS = np.asarray([[t[1] for t in row] for row in _TABLE], np.uint8).ravel()


def code_point_classes() -> np.ndarray:
    """The class of every code point and of STOP_POINT, by the tiktoken library's character tables."""
    import tiktoken

    every = np.concatenate((np.arange(0xD800), np.arange(0xE000, STOP_POINT))).astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    out = np.full(STOP_POINT + 1, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = cls
    for letters, cls in ((" ", BLANK), ("'", QUOTE), ("stmd", S1), ("rv", RV), ("l", LL), ("e", E)):
        out[[ord(c) for c in letters]] = cls
    out[STOP_POINT] = STOP
    return out


def state_scan(classes: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each character, and the state at the end, beginning in ``start``."""
    n = len(classes)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, STOP, np.uint8)
    grid[:n] = classes
    grid = (grid.reshape(blocks, BLOCK).T * np.uint8(STATES)).copy()  # place in the block, block
    # Function of each block: the end state for every begin state.
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES))
    for at in grid:
        whole = NEXT[at[:, None] + whole]
    # Prefix scan: before step k, row b composes the functions of the 2^k blocks that end with b.
    step = 1
    while step < blocks:
        whole = np.concatenate((whole[:step], np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)))
        step *= 2
    state = np.concatenate(([start], whole[:-1, start])).astype(np.uint8)
    before = np.empty((BLOCK, blocks), np.uint8)
    for at, here in zip(grid, before):
        here[:] = state
        state = NEXT[at + state]
    before = before.T.ravel()
    end = int(NEXT[int(classes[-1]) * STATES + int(before[n - 1])]) if n else start
    return before[:n], end


def boundaries(classes: np.ndarray) -> np.ndarray:
    """The places in ``classes`` (texts, a STOP after each) at which a pre-token or a STOP begins, in order."""
    begins = np.zeros(len(classes), bool)
    state = AT_STOP
    for at in range(0, len(classes), PART):
        part = classes[at:at + PART]
        before, state = state_scan(part, state)
        flags = FLAGS[part * np.uint8(STATES) + before]
        begins[at:at + len(part)] |= (flags & HERE) > 0
        late = np.flatnonzero(flags & BEFORE) + at - 1
        begins[late] = True
    return np.flatnonzero(begins)


class RankBPE:
    """A byte-level vocabulary of ranked byte strings: encoding, and decoding with offsets."""

    def __init__(self, path: str, cached: int = CACHED):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            bytes_of[rank] = token
        self.length = np.fromiter(map(len, bytes_of), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.classes = code_point_classes()
        self.width = np.ones(STOP_POINT + 1, np.uint8)  # bytes of a code point
        self.width[0x80:] = 2
        self.width[0x800:] = 3
        self.width[0x10000:] = 4
        self.width[STOP_POINT] = 0
        self.decimal = list(map(str, range(size)))
        self.cached = cached
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, the leftmost of equal ones, is merged until none is known."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > LONG:
            return self._merge_long(word)
        parts = [word[i:i + 1] for i in range(len(word))]
        none = len(self.length)
        pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (least := min(pair)) < none:
            i = pair.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """As ``merge`` with a heap of pairs and linked parts: n log n for n bytes."""
        ranks, n = self.ranks, len(word)
        stop = list(range(1, n + 1))  # part that begins at i ends at stop[i]; 0: no part begins there
        prev = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            mid = stop[i]
            if not mid or mid >= n or stop[mid] - i != size:
                continue  # one of the two parts has changed
            end = stop[i] = stop[mid]
            stop[mid] = 0
            if end < n:
                prev[end] = i
                if (r := ranks.get(word[i:stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end] - i))
            if i and (r := ranks.get(word[prev[i]:end])) is not None:
                heapq.heappush(heap, (r, prev[i], end - prev[i]))
        return [ranks[word[i:stop[i]]] for i in range(n) if stop[i]]

    def _ids(self, word: bytes) -> bytes:
        """Packed ids of a pre-token that is not in the newer half of the cache."""
        ids = self.old.get(word)
        if ids is None:
            ids = np.asarray(self.merge(word), "<i4").tobytes()
        if len(word) <= LONG:
            if len(self.new) >= self.cached:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, place at which each text's begin, and the end)."""
        stop = STOP_POINT.to_bytes(4, "little")
        points = np.frombuffer(b"".join([x for t in texts for x in (t.encode("utf-32-le"), stop)]), "<u4")
        raw = "".join(texts).encode()
        classes = self.classes[points]
        begins = boundaries(classes)
        at = (np.cumsum(self.width[points], dtype=np.int64) - self.width[points])[begins]
        ends = np.flatnonzero(classes[begins] == STOP)  # text ends are empty slices
        at = at.tolist()
        get = self.new.get
        found = [raw[a:b] for a, b in zip(at, at[1:])]
        found = [get(w) or (self._ids(w) if w else w) for w in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<i4")
        text_begins = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        return ids, text_begins

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins in the decoded ids, and the end."""
        known = (ids >= 0) & (ids < len(self.length))
        return np.concatenate(([0], np.cumsum(np.where(known, self.length[np.where(known, ids, 0)], 0))))

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ids; ``offsets`` as made by ``offsets`` (of these ids, from any first value)."""
        if offsets is None:
            offsets = self.offsets(ids)
        sizes = np.diff(offsets)
        ids = np.where(sizes > 0, ids, 0)
        return self.pool[np.repeat(self.begin[ids] - (offsets[:-1] - offsets[0]), sizes) + np.arange(sizes.sum())].tobytes()


_CODECS: dict[str, RankBPE] = {}


def codec(path: str) -> RankBPE:
    """One codec for each worker process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = RankBPE(path)
    return _CODECS[path]


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, offsets (arrays; the byte of the text at which each id begins) of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, begins = c.encode(texts)
                offsets = c.offsets(ids)[:-1]
                own = np.append(offsets, 0)[np.minimum(begins[:-1], len(offsets))]
                offsets = offsets - np.repeat(own, np.diff(begins))
                cut = pa.array(begins, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())),
                     pa.ListArray.from_arrays(cut, pa.array(offsets, pa.int64()))], ["doc_id", "ids", "offsets"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data (bytes), text (broken UTF-8 replaced) of each row of ``tokens`` (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [c.decode(np.asarray(ids or [], np.int64)) for ids in column(part, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data])],
                    ["doc_id", "data", "text"])

    tokens = tokens.selectExpr("CAST(doc_id AS long) AS doc_id", "transform(ids, x -> coalesce(x, -1)) AS ids")
    return tokens.mapInArrow(run, "doc_id long, data binary, text string")


def excerpts(tokens: DataFrame, ranks_path: str, first: str, stop: str) -> DataFrame:
    """doc_id, data: the bytes from ``first`` up to ``stop`` (columns) of each text of ``tokens`` (doc_id, ids, offsets).

    Offsets find the ids that overlap the range, so only these are decoded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            data = []
            for ids, offsets, a, b in zip(*(column(batch, n).to_pylist() for n in ("ids", "offsets", "a", "b"))):
                ids, offsets = np.asarray(ids or [], np.int64), np.asarray(offsets or [], np.int64)
                a, b = max(a or 0, 0), max(b or 0, 0)
                i = max(int(np.searchsorted(offsets, a, "right")) - 1, 0)
                j = max(int(np.searchsorted(offsets, b, "left")), i)
                here = int(offsets[i]) if i < len(offsets) else 0
                data.append(c.decode(ids[i:j])[max(a - here, 0):max(b - here, 0)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    tokens = tokens.selectExpr("CAST(doc_id AS long) AS doc_id", "ids", "offsets", f"CAST(`{first}` AS long) AS a", f"CAST(`{stop}` AS long) AS b")
    return tokens.mapInArrow(run, "doc_id long, data binary")


def codec_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: an encode and decode round trip of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, begins = c.encode(texts)
                offsets = c.offsets(ids)
                back = c.decode(ids, offsets)
                named = list(map(c.decimal.__getitem__, ids.tolist()))
                cut, bytes_at = begins.tolist(), offsets[begins].tolist()
                rows = [(b - a, hashlib.sha256(",".join(named[a:b]).encode()).hexdigest(), hashlib.sha256(back[x:y]).hexdigest())
                        for a, b, x, y in zip(cut, cut[1:], bytes_at, bytes_at[1:])]
                n, said, text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(said), pa.array(text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
