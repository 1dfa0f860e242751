"""Packing documents into fixed training windows (best-fit decreasing).

Every document becomes a run of token ids that ends with a separator id. Runs longer than a
window are cut into full windows first. What is left is packed longest first; each remnant
goes into the open window with the least capacity that still holds it, found by a segment
tree over capacities. Windows that stay badly filled at the end are cut at powers of two,
because a sequence of such a length needs no padding.

Spark deals the documents; each task packs the remnants that it holds (``buffer_ids``
token ids at a time), so nothing is shuffled, no task sees the whole corpus, and a lost
task can be run again alone with the same outcome. The price is one group of windows cut at
powers of two per buffer instead of one for the corpus.

Defined cases: a NULL or empty text is the lone separator; a NULL doc_id is kept; repeated rows
are packed each on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from carelens.llm.common import column, kept_by, text_slices

WINDOW = 2048
SEPARATOR = 1
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long, sequence_tokens long")
#: Sequence numbers one task may use; partition number times this is the task's first number.
SEQUENCES_PER_TASK = 1 << 40
#: Fixed value: the pre-token pattern of the tokenizers that can be encoded word by word.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longer words are not kept in the cache.
LONG_WORD = 200
#: Where Python and tokenizers may disagree on what is white space, only ASCII spaces cut words.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: ASCII marks that are neither letters nor digits, without the apostrophe (it begins contractions).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class CapacityTree:
    """Counts of open windows by remaining capacity, with the tightest fit in O(log window).

    Leaf c holds how many open windows have capacity c; an inner node holds the sum below it.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, delta: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += delta
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need with an open window, or -1."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths`` (each 1..window), longest first."""
    tree = CapacityTree(window)
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]
    windows: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = tree.tightest(n)
        if capacity < 0:
            w, capacity = len(windows), window
            windows.append([i])
        else:
            w = open_windows[capacity].pop()
            tree.add(capacity, -1)
            windows[w].append(i)
        if capacity > n:
            open_windows[capacity - n].append(w)
            tree.add(capacity - n, 1)
    return windows


def _powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(pieces: list[tuple[int, int]], window: int, fill: float) -> list[tuple[int, int, int, int, int, int]]:
    """(piece, part start, part length, sequence, offset, sequence length) for pieces (id, length).

    ``fill``: windows filled less than this share are cut at powers of two.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    lengths = np.fromiter((n for _, n in pieces), np.int64, len(pieces))
    seq = 0
    for members in best_fit_decreasing(lengths, window):
        total = int(lengths[members].sum())
        sizes = [total] if total >= fill * window else _powers(total)
        k, offset = 0, 0
        for i in members:
            at, left = 0, int(lengths[i])
            while left:
                part = min(left, sizes[k] - offset)
                out.append((pieces[i][0], at, part, seq + k, offset, sizes[k]))
                at, left, offset = at + part, left - part, offset + part
                if offset == sizes[k]:
                    k, offset = k + 1, 0
        seq += len(sizes)
    return out


class Room:
    """Keeps a dictionary below about ``budget`` bytes by emptying it.

    The dictionary itself stays a plain one: set operations and lookups are much slower on subclasses.
    """

    #: Bytes of an entry besides its text and ids: object headers and its place in the dictionary.
    ENTRY = 120

    def __init__(self, budget: int):
        self.budget = budget
        self.size = 0

    def make(self, cache: dict, new: int, text: int) -> bool:
        """Make room for ``new`` entries with ``text`` characters; False if all others had to go for it."""
        self.size += new * self.ENTRY + 2 * text
        if self.size <= self.budget:
            return True
        cache.clear()
        self.size = 0
        return False


class WordIds:
    """Token ids (as little-endian uint32 bytes) of texts, cached by white-space separated word.

    Where a tokenizer drops white space, never joins across it, folds case, and cuts between
    letters or digits and other characters, a text's ids are its words' ids in a row, and a
    word's those of its lower case without its trailing punctuation, then of that punctuation.
    Words that may hold a special token are encoded as they are. Other tokenizers (see
    ``by_words``) encode whole texts. The caches hold about ``budget`` bytes together.
    """

    def __init__(self, path: str, budget: int = 224 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple({t.content[:1] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.words: dict[str, bytes] = {}  # by word as it stands
        self.parts: dict[str, bytes] = {}  # by folded word or punctuation
        self.word_room, self.part_room = Room(budget * 5 // 8), Room(budget * 3 // 8)

    def _split(self, word: str) -> tuple[str, str]:
        """A word as two parts that are encoded alone."""
        for c in self.special:
            if c in word:
                return word, ""
        if word.isascii():
            word = word.lower()
            stem = word.rstrip(PUNCTUATION)
            return (stem, word[len(stem):]) if stem[-1:].isalnum() else (word, "")
        stem = word.rstrip(PUNCTUATION)
        if len(stem) == len(word):
            return word, ""
        # The stem must end in a letter or digit after normalisation and lower-casing too.
        last = unicodedata.normalize("NFC", stem[-1:]).lower()
        return (stem, word[len(stem):]) if len(last) == 1 and (last.isalpha() or last.isdigit()) else (word, "")

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts, many in one text; their ids are told apart by where tokens begin."""
        for at in range(0, len(parts), 1000):
            some = parts[at:at + 1000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum(np.fromiter((len(p) + 1 for p in some), np.int64, len(some)))
            place = np.searchsorted(begins, np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets)), "right")
            cut = (4 * np.searchsorted(place, np.arange(len(some) + 1))).tolist()
            ids = np.asarray(e.ids, "<u4").tobytes()
            self.parts.update(zip(some, [ids[a:b] for a, b in zip(cut, cut[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        rows = [ASCII_SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        words, parts = self.words, self.parts
        missing = set().union(*rows).difference(words)
        if not self.word_room.make(words, len(missing), sum(map(len, missing))):
            missing = set().union(*rows)
            self.word_room.make(words, len(missing), sum(map(len, missing)))
        split = {w: self._split(w) for w in missing}
        new = set().union(*split.values()).difference(parts)
        if not self.part_room.make(parts, len(new), sum(map(len, new))):
            new = set().union(*split.values())
            self.part_room.make(parts, len(new), sum(map(len, new)))
        parts[""] = b""
        self._learn([p for p in new if p])
        words.update({w: parts[a] + parts[b] if b else parts[a] for w, (a, b) in split.items()})
        out = [b"".join([words[w] for w in r]) for r in rows]
        for cache, added in ((words, missing), (parts, new)):
            for w in added:
                if len(w) > LONG_WORD:
                    del cache[w]
        return out


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file (as JSON) is of the kind whose texts can be encoded word by word.

    Its normalizer composes characters, makes any white space one space and folds case; its
    pre-tokenizer drops spaces and cuts letters, digits and other characters apart; nothing is
    added around a text.
    """
    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal = steps(spec.get("normalizer"), "normalizers")
    cuts = steps(spec.get("pre_tokenizer"), "pretokenizers")
    folds = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
    spaces = folds and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    parts = [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_PARTS} and (
        cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("Removed", True, False, False)
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    return spaces and parts and plain and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process and vocabulary, until a task of another step begins there."""
    encoders = kept_by("packing")
    if path not in encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders[path] = WordIds(path)
    return encoders[path]


def packed_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, separator: int = SEPARATOR,
                  fill: float = 0.97, buffer_ids: int = 8_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it lies in its document and its sequence.

    ``with_ids`` adds the piece's token ids (array of int), for writing training files. A task holds
    4 bytes for each id of its buffer, and its rows only until a thousand of them go on.
    """
    fields = [pa.field(n.split()[0], pa.int64()) for n in PIECE_SCHEMA.split(", ")]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)
    end = np.asarray([separator], "<u4").tobytes()
    emit_rows = 1_000

    def record_batch(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (doc_id, start, ids as bytes, doc_tokens, sequence_id, offset, sequence_tokens) as a batch."""
        doc, start, ids, doc_tokens, sequence, offset, total = zip(*rows)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        columns = [doc, start, n, list(map(zlib.crc32, ids)), doc_tokens, sequence, offset, total]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            cut = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        next_sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        rows: list[tuple] = []
        held: list[tuple] = []
        held_ids = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The held remnants, packed; each is let go once its last part is out."""
            nonlocal next_sequence, held_ids
            first, last, out = next_sequence, -1, []
            for i, at, n, seq, offset, total in pack([(i, len(h[2]) // 4) for i, h in enumerate(held)], window, fill):
                doc, start, ids, doc_tokens = held[i]
                out.append((doc, start + at, ids[4 * at:4 * (at + n)], doc_tokens, first + seq, offset, total))
                if 4 * (at + n) == len(ids):
                    held[i] = None
                last = max(last, seq)
                if len(out) >= emit_rows:
                    yield record_batch(out)
                    out = []
            if out:
                yield record_batch(out)
            next_sequence = first + last + 1
            held.clear()
            held_ids = 0

        for batch in batches:
            for part, texts in text_slices(batch):
                for doc, ids in zip(column(part, "doc_id").to_pylist(), encoder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    whole = n // window * window
                    for start in range(0, whole, window):
                        rows.append((doc, start, ids[4 * start:4 * (start + window)], n, next_sequence, 0, window))
                        next_sequence += 1
                        if len(rows) >= emit_rows:
                            yield record_batch(rows)
                            rows = []
                    if whole < n:
                        held.append((doc, whole, ids[4 * whole:], n))
                        held_ids += n - whole
                if held_ids >= buffer_ids:
                    yield from flush()
        if rows:
            yield record_batch(rows)
        yield from flush()

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))
