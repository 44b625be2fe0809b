"""Encoding of a corpus by a public byte-level BPE vocabulary, with batched numpy merges.

Texts are split by the vocabulary's pattern. Words not seen before in a task are merged together:
their symbols lie in one flat array, every round looks all neighbouring pairs up in the sorted
pair keys by binary search, and merges in each word all occurrences of its lowest-ranked pair. A
word leaves the array when no pair is left. Known words are kept in a bounded table.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.session import share

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
KEEP = 400_000  # words whose ids a task keeps; older ones are merged again when they come back

# The pattern of the vocabulary; white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary as arrays: id of each byte, sorted pair keys with rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.base = np.array([ids[c] for _, c in sorted(byte_letters().items())], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none empty)."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lens)
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, self.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(owner)))
            done = low == none
            for k in np.flatnonzero(done):
                out[owner[starts[k]]] = sym[starts[k] : starts[k] + size[k]].astype(np.int32)
            take = (rank == np.repeat(low, size)) & (rank < none)
            # of overlapping occurrences (a a a) every other one merges, from the left
            idx = np.flatnonzero(take)
            if len(idx):
                first = np.append(True, (np.diff(idx) != 1) | (rank[idx[1:]] != rank[idx[:-1]]) | (owner[idx[1:]] != owner[idx[:-1]]))
                place = np.arange(len(idx))
                idx = idx[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
                sym[idx] = self.merged[at[idx]]
            keep = np.repeat(~done, size)
            keep[idx + 1] = False
            sym, owner = sym[keep], owner[keep]
        return out


class Encoder:
    """Encodes texts one after the other; its table of known words never exceeds KEEP."""

    def __init__(self, bpe: Bpe):
        import regex

        self.bpe, self.find = bpe, regex.compile(PATTERN).findall
        self.place: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        if len(self.place) + len(words) > KEEP:
            self.place.clear()
            self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.bpe.merge([w.encode("utf-8", "replace") for w in words])
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; null and empty texts have none."""
        split = [self.find(t) if t else [] for t in texts]
        new = set().union(*split) - self.place.keys()
        if new:
            if len(self.place) + len(new) > KEEP:
                new = set().union(*split)
            self._learn(list(new))
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        get = self.place.__getitem__
        at = np.fromiter((p for words in split for p in map(get, words)), dtype=np.int64, count=int(counts.sum()))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        pick = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - sizes), sizes)
        total = np.append(0, ends)
        offsets = np.append(0, total[np.cumsum(counts)])
        return offsets, self.flat[pick]


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): token ids of each text, without special tokens.

    Text that looks like a special token is plain text. Null and empty texts give an empty list.
    Repeated rows each give their row, extra columns are ignored, an empty table gives none. The
    vocabulary file is read on the driver only; its arrays (some 50,000 entries) are broadcast.
    """
    bpe = share(docs.sparkSession, Bpe(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pickle.loads(bpe.value))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            step = 256
            for k in range(0, len(texts), step):
                offsets, flat = encoder.encode(texts[k : k + step])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(k, step), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")
