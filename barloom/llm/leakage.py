"""Evaluation passages in a corpus, by pigeonhole edit matching.

Passages and texts are compared as strings of folded letters and digits only, so that spacing,
punctuation, accents and split words don't matter; word ends are kept beside them. A passage is cut
into pieces so short that any run of ``words`` words with at most ``budget`` errors holds one piece
without error. A multi-pattern automaton finds the pieces; every hit is decided by Myers'
bit-parallel edit distance of the runs around it. A run without error must also begin and end where
words of the text do.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import repair
from barloom.session import share

WORDS = 15
BUDGET = 1
BLOCK = 5_000  # items in one automaton: bounds what is sent to the workers at once
KEPT = 4  # automata that a worker keeps; more blocks are built anew for each batch

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")


def words_of(text: str) -> list[str]:
    """Folded words; a word split at a line end gives its two parts, which squeezing joins."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", repair(text).casefold()))
    return _WORD.findall(text.casefold())


def ends_of(words: list[str]) -> list[int]:
    """Where words end in the squeezed text, which is their letters and digits in one string."""
    return list(accumulate(map(len, words)))


def myers(pattern: str, text: str) -> tuple[int, list[int]]:
    """Least edit distance between ``pattern`` and any substring of ``text``, and where the best
    substrings end; bit-parallel.
    """
    m = len(pattern)
    if not m:
        return 0, [0]
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, ends = m, [0]
    for at, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
        if score < best:
            best, ends = score, [at]
        elif score == best:
            ends.append(at)
    return best, ends


class Items:
    """Squeezed passages with their word places, and their pieces by text."""

    def __init__(self, rows: list[tuple[int, str]], words: int = WORDS, budget: int = BUDGET):
        self.words, self.budget = words, budget
        # any run of ``words`` words then holds budget + 1 whole pieces, one of which has no error
        self.step = step = (words + 1) // (budget + 2)
        self.items: dict[int, tuple[str, list[int], list[int]]] = {}
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for item, passage in rows:
            tokens = words_of(passage)
            text, e = "".join(tokens), ends_of(tokens)
            b = [0, *e[:-1]]
            if len(tokens) < words:
                continue
            self.items[item] = (text, b, e)
            for k in range(0, len(b) - step + 1, step):
                self.pieces.setdefault(text[b[k] : e[k + step - 1]], []).append((item, k))

    def leaks(self, find, tokens: list[str]) -> dict[int, int]:
        """Items of which a text, given by its words, holds a run within the budget, with the distance."""
        body = "".join(tokens)
        hits: dict[int, set[tuple[int, int]]] = {}
        for end, piece in find(body):
            start = end + 1 - len(piece)
            for item, k in self.pieces[piece]:
                shift = start - self.items[item][1][k]
                if self.budget > 1 or self._hopeful(item, shift, k, body):
                    hits.setdefault(item, set()).add((shift, k))
        if not hits:
            return {}
        ends = {0, *ends_of(tokens)}
        found = {}
        for item, places in hits.items():
            best = self.budget + 1
            for shift, k in sorted(places):
                best = min(best, self._verify(item, shift, k, body, ends))
                if not best:
                    break
            if best <= self.budget:
                found[item] = best
        return found

    def _hopeful(self, item: int, shift: int, k: int, body: str) -> bool:
        """Whether a run with at most one error can lie around a piece: the words beside it that
        are whole, and those behind one word with the error, must make up the run.
        """
        text, b, e = self.items[item]
        left, right = k, k + self.step
        while left > 0 and k - left < self.words and b[left - 1] + shift >= 0 and body.startswith(text[b[left - 1] : e[left - 1]], b[left - 1] + shift):
            left -= 1
        while right < len(b) and right - k < self.words and body.startswith(text[b[right] : e[right]], b[right] + shift):
            right += 1
        need = self.words - self.budget - (right - left)
        if need <= 0 or not self.budget:
            return need <= 0
        for lo, hi in ((left - 1 - need, left - 2), (right + 1, right + need)):
            if lo >= 0 and hi < len(b) and body.find(text[b[lo] : e[hi]], max(0, b[lo] + shift - 1), max(0, e[hi] + shift + 1)) >= 0:
                return True
        return False

    def _verify(self, item: int, shift: int, piece: int, body: str, ends: set[int]) -> int:
        """The least distance of the runs around a piece, by Myers: 0 only for whole words, 1 for
        the same run as part of longer words.
        """
        text, b, e = self.items[item]
        best = self.budget + 1
        for k in range(max(0, piece + self.step - self.words), min(piece, len(b) - self.words) + 1):
            lo, hi = b[k], e[k + self.words - 1]
            start = max(0, lo + shift - self.budget)
            near = body[start : max(0, hi + shift + self.budget)]
            if len(near) < hi - lo - self.budget:
                continue
            distance, stops = myers(text[lo:hi], near)
            if not distance:
                whole = any(start + at in ends and start + at - (hi - lo) in ends for at in stops)
                if whole:
                    return 0
                distance = 1
            best = min(best, distance)
        return best


def leaked_items(docs: DataFrame, items: DataFrame, words: int = WORDS, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance): texts that hold ``words`` successive words of a passage.

    Distance 0 is an exact run of whole words after folding; larger ones are the edit distance of
    the best run, letters and digits only. The corpus is read once, whatever the number of items:
    they go to the workers in blocks of about ``block``, which take turns on each batch of texts.
    Null, empty and short passages and texts leak nothing. Rows repeated in either table give one
    row each pair; extra columns are ignored.
    """
    spark = docs.sparkSession
    held = items.where(F.col("passage").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "passage")
    blocks = max(1, -(-held.count() // block))
    shared = []
    for k in range(blocks):
        rows = [tuple(r) for r in held.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k).collect()]
        # rows of the same item_id stay apart under numbers of their own
        shared.append(share(spark, (Items([(n, r[1]) for n, r in enumerate(rows)], words, budget), [r[0] for r in rows])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ready: dict[int, tuple] = {}

        def load(k: int) -> tuple:
            if k not in ready:
                known, names = pickle.loads(shared[k].value)
                automaton = ahocorasick.Automaton()
                for piece in known.pieces:
                    automaton.add_word(piece, piece)
                if known.pieces:
                    automaton.make_automaton()
                if len(shared) > KEPT:
                    ready.clear()
                ready[k] = known, names, automaton
            return ready[k]

        for batch in batches:
            texts = [(doc, words_of(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text]
            out: list[tuple[int, int, int]] = []
            for k in range(len(shared)):
                known, names, automaton = load(k)
                if known.pieces:
                    for doc, tokens in texts:
                        out += [(doc, names[i], d) for i, d in known.leaks(automaton.iter, tokens).items()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["doc_id", "item_id", "distance"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, distance int")
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
