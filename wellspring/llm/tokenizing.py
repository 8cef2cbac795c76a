"""Encoding of texts by a byte-level BPE vocabulary with a prefix-sharing trie.

A BPE encoding is the one in which every two neighbouring tokens, encoded
together, stay those two tokens. So the last token of a prefix determines the
rest: it is the only vocabulary token that ends the prefix and may follow the
last token of what comes before it. The distinct words of a batch go into a
trie in sorted order, that is depth first; a node's last token follows from its
ancestors' and is computed once, however many words share the prefix.

Every partition has its own trie, so nothing is shuffled; it is begun afresh
when it has grown to MAX_NODES, which bounds memory and changes no result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public vocabulary splits text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_NODES = 2_000_000
MAX_WORDS = 500_000


class TrieEncoder:
    """Ids of words by last-token states on a byte trie."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]

    def _merged(self, piece: bytes) -> list[bytes]:
        """Merge by rank, from the definition; only for pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.pairs[key] = self._merged(a + b) == [a, b]
        return known

    def _alone(self, token: int) -> bool:
        key = (-1, token)
        known = self.pairs.get(key)
        if known is None:
            b = self.bytes_of[token]
            known = self.pairs[key] = self._merged(b) == [b]
        return known

    def _insert(self, word: bytes) -> list[int]:
        """Ids of a word; nodes made on the way get their last token."""
        path, node = [0], 0
        children, last, ranks = self.children, self.last, self.ranks
        for end in range(1, len(word) + 1):
            child = children[node].get(word[end - 1])
            if child is None:
                child = len(last)
                children[node][word[end - 1]] = child
                children.append({})
                token = -1
                for start in range(max(0, end - self.longest), end):
                    t = ranks.get(word[start:end])
                    if t is not None and (self._may_follow(last[path[start]], t) if start else self._alone(t)):
                        token = t
                        break
                last.append(token)
            path.append(child)
            node = child
        ids, end = [], len(word)
        while end:
            ids.append(last[path[end]])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def learn(self, words: set[str]) -> None:
        """Encode distinct words not met yet, in depth-first order."""
        if len(self.last) > MAX_NODES or len(self.words) > MAX_WORDS:
            self._clear()
            self.words = {}
            self.pairs = {k: v for k, v in self.pairs.items() if k[0] < 0} if len(self.pairs) > MAX_NODES else self.pairs
        new = [(w.encode(), w) for w in words if w not in self.words]
        for b, w in sorted(new):
            self.words[w] = self._insert(b)


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> TrieEncoder:
    """One encoder per worker process and vocabulary file."""
    with open(vocabulary, "rb") as f:
        return TrieEncoder({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)})


_SPLIT = regex.compile(PATTERN)


def encode(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[list[int] | None]:
    """Ids of each text: empty list for empty text, None for None."""
    e = encoder(vocabulary)
    split = [None if t is None else _SPLIT.findall(t) for t in texts]
    if any(s and any(w not in e.words for w in s) for s in split):
        e.learn({w for s in split if s for w in s})
    words = e.words
    return [None if s is None else [i for w in s for i in words[w]] for s in split]


_CHUNK = 512  # texts encoded at a time


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text), without special tokens.

    An empty text has an empty list, a null text a null; a blank text has the
    ids of its blanks; strings of special tokens are ordinary text. Repeated
    rows are encoded alike; an empty table gives no rows; extra columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _CHUNK):
                part = b.slice(at, _CHUNK)
                ids = encode(part.column(1).to_pylist(), vocabulary)
                offsets = np.cumsum([0, *(len(i) if i else 0 for i in ids)], dtype=np.int32)
                flat = np.fromiter((x for i in ids if i for x in i), np.int32, int(offsets[-1]))
                nulls = pa.array([i is None for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=nulls)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, keep: tuple[str, ...], vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns (strings or longs) and n_tokens of each text, 0 for null."""
    names = [*keep, "n_tokens"]
    fields = documents.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[int] = []
            for at in range(0, b.num_rows, _CHUNK):
                n += [len(i or ()) for i in encode(b.slice(at, _CHUNK).column(len(keep)).to_pylist(), vocabulary)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return documents.select(*keep, "text").mapInArrow(run, schema)
