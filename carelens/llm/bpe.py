"""Byte-pair encoding and decoding by batched numpy merge rounds.

A text is cut into pre-tokens. New pre-tokens of a batch are encoded together: the symbols of
all of them lie in one flat array; in each round every word finds its pair of lowest rank by
binary search over the sorted pair keys (a rank is looked up again only where a symbol is new),
all its places of that pair are merged (left to right,
without overlap), and words without a known pair leave the array. Merging all places at once
equals merging one by one, as each merge of the vocabulary makes a symbol of its own, so a
symbol's later pairs always have higher ranks than the merge that made it (checked on loading).

Defined cases: NULL and empty texts have no ids and decode to ''; special tokens inside a text
get their own ids, as in the tokenizers library; repeated rows are encoded each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from carelens.llm.common import column, text_slices

#: The byte-level pre-token pattern of this vocabulary family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1 << 40)
CUT = re.compile(r" (?=\S)")
#: Parts longer than this are not kept in the cache.
LONG_PART = 200


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, all others are numbered from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(extra)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary with numpy encoding and exact decoding."""

    def __init__(self, path: str, cache_limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.asarray([vocab[s] for s in symbols], np.int64)
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.int64(size)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.asarray([vocab[a] for a, _ in pairs], np.int64)
        right = np.asarray([vocab[b] for _, b in pairs], np.int64)
        made = np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        rank_made = np.full(size, -1, np.int64)
        rank_made[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(rank_made[left], rank_made[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge makes a symbol that another one makes, or uses one made later")
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_limit = cache_limit
        self.id_text = [str(i) for i in range(size)]
        # (ids as text, number of ids, decoded bytes) by part of a text, and by pre-token
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.words: dict[str, tuple[str, int, bytes]] = {}

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at places ``at`` (NO_RANK for unknown ones and word ends)."""
        out = np.full(len(at), NO_RANK)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        key = sym[at[inside]] * self.base + sym[at[inside] + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[found] == key
        out[inside[known]] = self.ranks[found[known]]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (given as bytes) in a row, and where each word's begin and end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = self._ranks(sym, word, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, begins)
            best_here = np.repeat(best, np.diff(np.append(begins, len(sym))))
            over = best_here == NO_RANK
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, rank, best_here = sym[live], word[live], rank[live], best_here[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best_here)
            # Of places in a row (as in "aaa"), every second one overlaps the one before it.
            run = np.concatenate(([True], np.diff(hit) != 1))
            first = hit[np.flatnonzero(run)[np.cumsum(run) - 1]]
            hit = hit[(hit - first) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            now = hit - np.arange(len(hit))  # one symbol went for each merge before it
            changed = np.concatenate((now, now[now > 0] - 1))  # only pairs with a new symbol differ
            rank[changed] = self._ranks(sym, word, changed)
        ids, owner = np.empty(0, np.int64), np.empty(0, np.int64)
        if done:
            owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
        return ids, np.searchsorted(owner, np.arange(len(words) + 1))

    def chunks(self, text: str) -> list[str]:
        """Parts of ``text`` that pre-tokenize alike alone and in place.

        A space before a visible character always begins a pre-token, so texts can be cut there.
        """
        first, *rest = CUT.split(text)
        return [first, *[" " + p for p in rest]]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new parts; their pre-tokens that are new, too, are merged together."""
        find = self.pattern.findall
        words = [find(c) for c in chunks]
        known = self.words
        new = list(set().union(*words).difference(known)) if words else []
        if len(known) + len(new) > self.cache_limit:
            known.clear()
            new = list(set().union(*words))
        ids, cut = self.merge([w.encode() for w in new])
        flat, at = ids.tolist(), cut.tolist()
        text, raw = [self.id_text[i] for i in flat], [self.bytes_of[i] for i in flat]
        known.update({w: (",".join(text[a:b]), b - a, b"".join(raw[a:b])) for w, a, b in zip(new, at, at[1:])})
        for c, ws in zip(chunks, words):
            if len(ws) == 1:
                self.cache[c] = known[ws[0]]
            else:
                parts = [known[w] for w in ws]
                self.cache[c] = (",".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts]))
        for w in new:
            if len(w) > LONG_PART:
                del known[w]

    def encode_parts(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text the (ids as text, number, decoded bytes) of its parts in order."""
        per_text: list[list[str]] = []
        for t in texts:
            parts: list[str] = []
            if self.split_special and any(s in t for s in self.special):
                for piece in self.split_special.split(t):
                    parts.extend([piece] if piece in self.special else self.chunks(piece) if piece else [])
            else:
                parts = self.chunks(t) if t else []
            per_text.append(parts)
        missing = list(set().union(*per_text).difference(self.cache)) if per_text else []
        if len(self.cache) + len(missing) > self.cache_limit:
            self.cache.clear()
            missing = list(set().union(*per_text))
        special = {s: (str(i), 1, s.encode()) for s, i in self.special.items()}
        self.cache.update({s: v for s, v in special.items() if s in missing})
        self._learn([m for m in missing if m not in special])
        found = [[self.cache[p] for p in parts] for parts in per_text]
        for m in missing:
            if len(m) > LONG_PART:
                del self.cache[m]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for s, _, _ in self.encode_parts([text])[0] if s for i in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids are left out, broken UTF-8 gets replacement characters."""
        return b"".join([self.bytes_of[i] for i in ids if 0 <= i < len(self.bytes_of)]).decode("utf-8", "replace")


_CODECS: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = ByteBPE(path)
    return _CODECS[path]


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int) of each text of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids = [[int(i) for s, _, _ in parts if s for i in s.split(",")] for parts in c.encode_parts(texts)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of each row of ``tokens`` (doc_id, ids); NULL ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: an encode and decode round trip of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                n, ids, back = [], [], []
                for parts in c.encode_parts(texts):
                    n.append(sum([p[1] for p in parts]))
                    ids.append(hashlib.sha256(",".join([p[0] for p in parts if p[0]]).encode()).hexdigest())
                    text = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
