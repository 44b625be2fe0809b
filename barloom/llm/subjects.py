"""Subjects that rulings turn on, by weighted terms and a multi-pattern automaton.

Terms are words. Those of the labelled passages that occur under many subjects are the frame of the
language, those under one subject only are the seed. The corpus then decides which words are terms:
a word belongs to a subject if most of its occurrences, over all documents, stand in a sentence
with other terms of that subject. A sentence is scored for a subject by the weights of its terms, by
rarity, against its length; the threshold of each subject is calibrated on held-out passages.
Sentences that cite another case speak of that case and don't count, nor does a term alone in its
sentence: both are told by structure, not by wording.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import unwrap
from barloom.session import share, stash

FRAME_SUBJECTS = 4  # a word under so many subjects belongs to the frame
PURITY = 0.5  # share of the sentences with a term, in the whole corpus, that have others of its subject
CLASSES = 8  # classes of the mentions that a word stands beside
VARIETY = 0.5   # share of a term's company outside its largest class: no term by one companion only
SUPPORT = 5  # files (docket numbers) that must use a new term
MENTIONS = 2  # mentions that a sentence needs for a subject: one alone may be a comparison
TERMS = 3  # mentions that a subject needs in all such sentences: as many as a headnote has
EXAMPLES = 10_000  # labelled passages of a subject that are taken at most
BLOCK = 100_000  # terms in one automaton
GAP = 5  # letters between two terms of one mention, blanks included
FLUSH = 500_000  # words that a task counts before it hands them on

# Words that join two things, so that what they join are two mentions.
JOINING = {f" {w} " for w in ("and", "or", "nor", "und", "oder", "noch", "et", "ou", "ni", "y", "e", "o", "u")}

# German function words; German writes nouns with a capital, so capitals tell no names there.
GERMAN = {"der", "die", "das", "und", "des", "zu", "zur", "den", "dem", "für", "auch", "über", "seit", "wenn", "hat", "weder", "nach", "noch", "ist", "sind", "wer"}

_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
# a sentence ends at a point, but not at that of a short abbreviation with a capital (Rn., Rep., L.R.)
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[^\W\d_a-z]\.)(?<!\b[^\W\d_a-z]\w\.)(?<!\b[^\W\d_a-z]\w\w\.)(?<!\b[^\W\d_a-z]\w{3}\.)\s+(?=[^\W\d_a-zà-ÿ]|\W|\d)")
_YEAR = r"(?:1[5-9]|20)\d\d"
_CAPITAL = r"[^\W\d_a-z]"
# how cases are cited
_NEUTRAL = re.compile(rf"\[{_YEAR}\] ?{_CAPITAL}")  # [1979] ABC 152
_VOLUME = re.compile(rf"\({_YEAR}\) \d+ {_CAPITAL}")  # (1999) 35 Abc. 244
_FILE = re.compile("|".join(rf"/\d\d(?![\d/])(?<={_CAPITAL} {n}/\d\d)" for n in (r"\d", r"\d\d", r"\d\d\d", r"\d\d\d\d")))  # ABC 87/86
_VERSUS = re.compile(rf" v\.? {_CAPITAL}")  # Name v Name
_MATTER = re.compile(rf"\bRe {_CAPITAL}")  # Re Name
_REPORT = re.compile(rf"[12]\d\d\d {_CAPITAL}\w*\. ?{_CAPITAL}")  # 1984 Abc. D.E. 12
_OPENING = " §[]().-–—0123456789"  # what may stand before the first word of a sentence
_BEFORE = "(\"'«„“‘[/"  # signs that may stand before a word, beside a blank
_END = "\x01"
_SIGNS = "«»„“”‚‘’…–—§€£·•¿¡†‡°ºª"  # the usual signs beyond ASCII
_LETTERS = bytes(i if i > 127 or chr(i).isalpha() or chr(i) in "'-\x01" else 32 for i in range(256))


def sentences(text: str) -> list[str]:
    return _SENTENCE.split(unwrap(text).replace("’", "'"))


@dataclass
class Lexicon:
    frame: set[str]
    terms: dict[str, tuple[str, float]] = field(default_factory=dict)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, (subject, weight) in self.terms.items():
            a.add_word(f" {term}", (len(term), subject, weight))
        if self.terms:
            a.make_automaton()
        return a


def seed_lexicon(examples: list[tuple[str, str]]) -> Lexicon:
    """Frame and seed terms of labelled (text, subject) passages."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, subject in examples:
        for word in {m.lower() for m in _WORD.findall(unwrap(text).replace("’", "'"))}:
            counts[word][subject] += 1
    many = min(FRAME_SUBJECTS, max(2, len({s for _, s in examples})))
    lex = Lexicon({w for w, by in counts.items() if len(by) >= many or len(w) < 3})
    for word, by in counts.items():
        if word not in lex.frame and len(by) == 1:
            lex.terms[word] = (next(iter(by)), 1.0)
    return lex


def _apart(gap: str) -> bool:
    """Whether what stands between two terms makes two mentions of them: more than one short word."""
    return gap in JOINING or gap.count(" ") > 2 or not gap.replace(" ", "").replace("'", "").isalpha()


def cites(sentence: str) -> bool:
    """Whether a sentence cites a case; what each form must hold is looked for first."""
    return bool(
        ("[" in sentence and _NEUTRAL.search(sentence)) or ("/" in sentence and _FILE.search(sentence)) or ("(" in sentence and _VOLUME.search(sentence))
        or (" v" in sentence and _VERSUS.search(sentence)) or ("Re " in sentence and _MATTER.search(sentence)) or (". " in sentence and _REPORT.search(sentence))
    )


def _free(cased: str, low: str) -> bool:
    """Whether capitals tell no names in a sentence: German, or all in capitals."""
    return len(GERMAN.intersection(low.split(" "))) >= 2 or cased.isupper()


def _begin(sentence: str) -> int:
    """Where the first word of a sentence begins, behind paragraph numbers and brackets."""
    return len(sentence) - len(sentence.lstrip(_OPENING))


def scan(parts: list[str], automata: list, own: str | None = None, least: int = MENTIONS) -> Iterator[tuple[int, str, dict[str, list[tuple[int, int, float]]]]]:
    """Those of the sentences ``parts`` with ``least`` mentions of a subject: their numbers, the
    sentences in lower case, and their mentions by subject: (start, end, weight) of each.

    The automata run once over the whole text. A term begins and ends where a word does; with a
    capital within a sentence it is a name, but for German and for sentences in capitals. Terms
    that follow each other directly, or with one short word between, are one mention, of the subject
    of the weightiest. A sentence that cites a case other than the ruling's ``own`` docket
    number is left out.
    """
    cased = f" {_END} ".join(parts)
    low = cased.lower()
    if len(low) != len(cased):  # rare letters whose lower case is longer
        cased = low
    cased, low = f" {cased} ", f" {low} "
    plain = low
    for sign in _BEFORE:
        if sign in plain:
            plain = plain.replace(sign, " ")
    found: list[tuple[int, int, str, float]] = []
    for a in automata:
        for end, (n, subject, w) in a.iter(plain):
            after = plain[end + 1]
            if after == " " or not (after.isalnum() or after == "_" or (after in "'-" and plain[end + 2].isalnum())):
                found.append((end + 1 - n, end + 1, subject, w))
    if len(found) < least:
        return
    if len(automata) > 1:
        found.sort()
    found.append((len(low) + 1, 0, "", 0.0))
    k, start, stop = -1, 0, -1
    hits: list[tuple[int, int, str, float]] = []
    for hit in found:
        if hit[0] < stop:
            hits.append(hit)
            continue
        if len(hits) >= least:
            mentions = _mentions(hits, cased, low, start, stop, least)
            if mentions and not cites(parts[k].replace(own, "") if own else parts[k]):
                yield k, low[start:stop], mentions
        while stop < hit[0] and stop < len(low):
            start, stop, k = stop + 1, low.find(_END, stop + 1), k + 1
            if stop < 0:
                stop = len(low)
        hits = [hit]


def _mentions(hits: list, cased: str, low: str, start: int, stop: int, least: int) -> dict[str, list[tuple[int, int, float]]]:
    """Mentions of one sentence by subject, of subjects with ``least`` of them."""
    first = free = None
    groups: list[list] = []
    last = None
    for at, end, subject, w in hits:
        if cased[at] != low[at]:
            if free is None:
                free, first = _free(cased[start:stop], low[start:stop]), start + _begin(low[start:stop])
            if not free and at > first:
                continue
        if last is not None and (at - last == 1 or (at - last <= GAP and not _apart(low[last:at]))):
            group = groups[-1]
            group[1] = end - start
            if (w, subject) > (group[2], group[3]):
                group[2], group[3] = w, subject
        else:
            groups.append([at - start, end - start, w, subject])
        last = end
    if len(groups) < least:
        return {}
    out: dict[str, list[tuple[int, int, float]]] = {}
    for a, b, w, subject in groups:
        if subject in out:
            out[subject].append((a, b, w))
        else:
            out[subject] = [(a, b, w)]
    return out if least == 1 else {s: m for s, m in out.items() if len(m) >= least}


def word_sets(parts: list[str]) -> list[set[bytes]]:
    """The words of each sentence in lower case, in UTF-8: what stands between signs and digits."""
    low = _END.join(parts).lower()
    if not low.isascii():
        for sign in _SIGNS:
            if sign in low:
                low = low.replace(sign, " ")
    raw = low.encode("utf-8", "replace").translate(_LETTERS)
    for edge in (b" '", b"' ", b" -", b"- "):
        raw = raw.replace(edge, b"  ")
    return [set(x.split()) for x in raw.split(b"\x01")]


def company(parts: list[str], tokens: list[set[bytes]], own: str | None, automata: list) -> Iterator[tuple[str, int, set[bytes]]]:
    """Words that stand in a sentence beside mentions of a subject of which they are no part: the
    subject, the class of the mentions, or CLASSES if of several, and the words. Names are left out
    as far as a capital tells them. ``tokens`` are the words in question of the sentences ``parts``.
    """
    for k, low, mentions in scan(parts, automata, own, 1):
        small = tokens[k]
        names = [w for w in parts[k].lstrip(_OPENING).split(" ")[1:] if "A" <= w < "[" or "À" <= w < "ß"]
        if names and not _free(parts[k], low):
            small = small.difference(*word_sets([" ".join(names)]))
        for subject, spots in mentions.items():
            classes = []
            part: dict[bytes, list[int]] = {}  # classes of the mentions of which a word is part
            for a, b, _ in spots:
                mention = low[a:b].encode()
                c = crc32(mention) % CLASSES
                classes.append(c)
                for word in mention.split(b" "):
                    part.setdefault(word, []).append(c)
            kinds = set(classes)
            beside = {next(iter(kinds)) if len(kinds) == 1 else CLASSES: small.difference(part)}
            if len(spots) > 1:
                every = Counter(classes) if len(kinds) < len(classes) else None
                for word, held in part.items():
                    if word in small:
                        left = kinds.difference(held) if every is None else [c for c in kinds if held.count(c) < every[c]]
                        if left:
                            beside.setdefault(next(iter(left)) if len(left) == 1 else CLASSES, set()).add(word)
            for c, words in beside.items():
                yield subject, c, words


def subjects_of(text: str, automata: list, thresholds: dict[str, float], own: str | None = None) -> dict[str, float]:
    """Subjects with their best sentence's score, where it reaches the subject's threshold.

    A sentence's score for a subject is the weight of its mentions over the square root of its
    length in units of twelve words, so that a long sentence needs more of them.
    """
    best: dict[str, float] = {}
    count: Counter = Counter()
    for _, low, mentions in scan(sentences(text), automata, own):
        length = math.sqrt(max(1.0, low.count(" ") / 12))
        for subject, spots in mentions.items():
            best[subject] = max(best.get(subject, 0.0), sum(w for _, _, w in spots) / length)
            count[subject] += len(spots)
    return {s: w for s, w in best.items() if w >= thresholds.get(s, 0.0) and count[s] >= TERMS}


def calibrate(examples: list[tuple[str, str]], folds: int = 4) -> dict[str, tuple[float, float, float]]:
    """Threshold, precision and recall of each subject on held-out passages.

    Each fold is scored by a lexicon of the other folds. The threshold lies in the middle of those
    that give the best F1, between the highest score that must stay below it and the lowest that
    must reach it. Passages on one subject are the other subjects' counterexamples.
    """
    examples = sorted(set(examples))
    subjects = sorted({s for _, s in examples})
    scores: dict[str, list[tuple[float, bool]]] = {s: [] for s in subjects}
    for k in range(folds):
        automata = [seed_lexicon([e for i, e in enumerate(examples) if i % folds != k]).automaton()]
        if not len(automata[0]):
            continue
        for text, subject in examples[k::folds]:
            best: dict[str, float] = {}
            for _, low, mentions in scan(sentences(text), automata):
                length = math.sqrt(max(1.0, low.count(" ") / 12))
                for s, spots in mentions.items():
                    best[s] = max(best.get(s, 0.0), sum(w for _, _, w in spots) / length)
            for s in subjects:
                scores[s].append((best.get(s, 0.0), s == subject))
    out = {}
    for s, rows in scores.items():
        values = sorted({v for v, _ in rows} | {0.0})
        own = sum(y for _, y in rows)
        tried = []
        for low, high in zip(values, values[1:]):
            hits = sum(y for v, y in rows if v >= high)
            all_ = sum(v >= high for v, _ in rows)
            tried.append((2 * hits / (all_ + own), -high, (low + high) / 2, hits / all_, hits / own))
        out[s] = max(tried)[2:] if tried else (0.0, 0.0, 0.0)
    return out


def corpus_terms(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(term, subject, weight): the words of the whole corpus that belong to a subject.

    Sentences are counted over all documents, those in which a word has a subject's company and all
    that hold it, within tasks first; a sentence repeated within a text counts once. A word is a
    term if at least PURITY of its sentences give it the company of one subject, in SUPPORT files and beside VARIETY of its terms; words of the labelled passages need no support. These are shares
    and numbers of files, so that a corpus and its repetitions give the same terms. The weight is
    the share times the rarity against the usual term.
    """
    shared = share(docs.sparkSession, lex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = pickle.loads(shared.value)
        automata = [lex.automaton()] if lex.terms else []
        frame = {w.encode() for w in lex.frame}
        total: Counter = Counter()
        beside: dict[tuple[str, int], Counter] = defaultdict(Counter)
        files: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            keys = [*((w, None, None) for w in total), *((w, s, c) for (s, c), words in beside.items() for w in words)]
            n = [*total.values(), *(n for words in beside.values() for n in words.values())]
            bits = [*([0] * len(total)), *(files[s][w] for (s, _), words in beside.items() for w in words)]
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _, _ in keys], pa.string()), pa.array([s for _, s, _ in keys], pa.string()), pa.array([c for _, _, c in keys], pa.int32()), pa.array(n, pa.int64()), pa.array(bits, pa.int64())], ["term", "subject", "class", "n", "files"])
            total.clear(), beside.clear(), files.clear()
            return batch

        for batch in batches:
            for bit, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text and automata:
                    parts = list(dict.fromkeys(sentences(text)))
                    tokens = [words - frame for words in word_sets(parts)]
                    for words in tokens:
                        total.update(words)
                    seen: dict[str, set[bytes]] = defaultdict(set)
                    for subject, c, words in company(parts, tokens, own, automata):
                        beside[subject, c].update(words)
                        seen[subject] |= words
                    for subject, words in seen.items():
                        known = files[subject]
                        for word in words:
                            known[word] |= bit
            if len(total) + sum(map(len, beside.values())) > FLUSH:
                yield rows()
        yield rows()

    # files in 63 classes: enough to tell five from one, and no wide key is shuffled
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(docket_no), 63) as int))")
    src = docs.select(bit.alias("bit"), F.col("docket_no").cast("string").alias("own"), "text")
    counts = src.mapInArrow(count, "term string, subject string, class int, n long, files long")
    single = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)) for c in range(CLASSES)]
    counts = counts.groupBy("term", "subject").agg(F.sum("n").alias("n"), F.bit_or("files").alias("files"), (F.sum("n") - F.greatest(*single)).alias("varied"))
    found = F.when(F.col("subject").isNotNull(), F.struct("varied", "n", "subject", F.bit_count("files").alias("files")))
    words = counts.groupBy("term").agg(F.max(F.when(F.col("subject").isNull(), F.col("n"))).alias("total"), F.max(found).alias("top"))
    seed = docs.sparkSession.createDataFrame([(t, s) for t, (s, _) in lex.terms.items()], "seed string, label string")
    words = words.join(seed, F.col("term") == F.col("seed"), "left")
    share_ = F.col("top.n") / F.col("total")
    good = (share_ >= PURITY) & (F.col("top.varied") >= VARIETY * F.col("top.n")) & ((F.col("top.files") >= SUPPORT) | F.col("label").eqNullSafe(F.col("top.subject")))
    terms = stash(words.where(good & (F.length("term") >= 3)).select("term", "top.subject", "total", share_.alias("share")), "terms")
    usual = terms.agg(F.expr("percentile_approx(total, 0.5, 10000)")).first()[0] or 1
    rarity = 1 + 0.1 * F.log(F.lit(float(usual)) / F.col("total"))
    return terms.select("term", "subject", ((0.5 + 0.5 * F.col("share")) * F.least(F.greatest(rarity, F.lit(0.5)), F.lit(1.5))).alias("weight"))


def labelled_passages(examples: DataFrame) -> list[tuple[str, str]]:
    """At most EXAMPLES (text, subject) of each subject, by the smallest hashes; no repeats or nulls."""
    from pyspark.sql import Window

    held = examples.where("text is not null and subject is not null").select("text", "subject").distinct()
    order = Window.partitionBy("subject").orderBy(F.xxhash64("text"), "text")
    return [tuple(r) for r in held.withColumn("k", F.row_number().over(order)).where(F.col("k") <= EXAMPLES).drop("k").collect()]


def subject_thresholds(examples: DataFrame) -> DataFrame:
    """(subject, threshold, precision, recall) as calibrated on held-out labelled passages."""
    rows = [(s, *v) for s, v in sorted(calibrate(labelled_passages(examples)).items())]
    return examples.sparkSession.createDataFrame(rows, "subject string, threshold double, precision double, recall double")


def document_subjects(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, subject, score) of the subjects that each ruling turns on.

    Texts without words, and rulings on procedure alone, have none. The language comes from the
    text, whatever the lang column says. Repeated rows give their subjects once; extra columns are
    ignored; without examples no subject is known and the result is empty. Terms go to the workers
    in blocks of about BLOCK, each with an automaton of its own, so that any number of them is used.
    """
    spark = docs.sparkSession
    labelled = labelled_passages(examples)
    seed = seed_lexicon(labelled)
    limits = {s: v[0] for s, v in calibrate(labelled).items()}
    terms = stash(corpus_terms(docs, seed), "lexicon")
    blocks = max(1, -(-terms.count() // BLOCK))
    shared = []
    for k in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()
        shared.append(share(spark, Lexicon(set(), {r["term"]: (r["subject"], r["weight"]) for r in rows})))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [lex.automaton() for lex in (pickle.loads(b.value) for b in shared) if lex.terms]
        for batch in batches:
            out = []
            if automata:
                for doc, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if text:
                        out += [(doc, s, w) for s, w in subjects_of(text, automata, limits, own).items()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["doc_id", "subject", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("docket_no").cast("string").alias("own"), "text")
    found = src.mapInArrow(assign, "doc_id long, subject string, score double")
    return found.groupBy("doc_id", "subject").agg(F.max("score").alias("score"))
