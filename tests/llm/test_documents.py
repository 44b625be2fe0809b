"""Operators on documents: against the public encoder, brute force and held-out passages."""

import os
import random
import re

import pytest

from barloom.llm.leakage import Items, leaked_items, myers, words_of
from barloom.llm.subjects import calibrate, document_subjects, scan, seed_lexicon, sentences, subject_thresholds
from barloom.llm.text import repair, unwrap
from barloom.llm.tokens import VOCABULARY, Bpe, Encoder, encode_corpus

ODD = [
    "", None, " ", "a" * 3000, " " * 70 + "x", "it's we're I'LL don’t", "<|endoftext|> plain", "naïve café ﬁ ½ ǅ", "日本語テキスト 123４５６", "👩‍👩‍👧 ok", "tab\t\tnew\r\nline  ", "x\u0085y\x1cz​", "aaaa aaaaa aaab", "ﷺ" * 5, "﻿start",
]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_ids_equal_the_public_encoder(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abcde  éß漢.,'-\n😀1") for _ in range(rnd.randrange(200))) for _ in range(200)]
    known = Tokenizer.from_file(VOCABULARY)
    known.encode_special_tokens = True
    want = [x.ids for x in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert known.decode(got[5]) == texts[5]
    assert encode_corpus(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_known_words_are_bounded(monkeypatch):
    import barloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "KEEP", 10)
    e = Encoder(Bpe(VOCABULARY))
    one = e.encode(["alpha beta gamma delta", "one two three four five six seven", "alpha two"])
    two = Encoder(e.bpe).encode(["alpha beta gamma delta", "one two three four five six seven", "alpha two"])
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()
    assert e.encode(["zeta eta theta iota kappa lambda mu nu xi", "alpha"])[1].tolist() == Encoder(e.bpe).encode(["zeta eta theta iota kappa lambda mu nu xi", "alpha"])[1].tolist()


def distance(a, b):
    """Least edit distance of a to a substring of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 90))) for _ in range(2))
        least, ends = myers(a, b)
        assert least == distance(a, b)
        assert all(min(distance(a, b[k:e]) for k in range(e + 1)) == least for e in ends[:3])


WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(300)]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([8, 14, 15, 40, 60])))) for i in range(40)]
    docs = []
    for d in range(150):
        words = [rnd.choice(WORDS) for _ in range(80)]
        _, passage = rnd.choice(items)
        p = passage.split()
        n = min(len(p), rnd.choice([5, 13, 14, 15, 16, 30]))
        at = rnd.randrange(len(p) - n + 1)
        words[20:20] = p[at : at + n]
        text = "; ".join(words) if d % 3 else "\n".join(w.upper() for w in words)
        docs.append((d, text.replace("é", "é") if d % 2 else text))
    grams = {}
    for i, passage in items:
        p = passage.split()
        for k in range(len(p) - 14):
            grams.setdefault(tuple(p[k : k + 15]), set()).add(i)
    want = set()
    for d, text in docs:
        w = [x for x in re.findall(r"[^\W_]+", text.lower().replace("é", "é"))]
        for k in range(len(w) - 14):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 15]), ())}
    a = spark.createDataFrame([*docs, (900, None), (901, ""), docs[0]], "doc_id long, text string")
    b = spark.createDataFrame([*items, (77, None), (78, "short")], "item_id long, passage string")
    for block in (5000, 7):
        got = leaked_items(a, b, block=block).where("distance = 0")
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert leaked_items(a.limit(0), b).count() == 0 and leaked_items(a, b.limit(0)).count() == 0


def searcher(passages, words=15, budget=1):
    import ahocorasick

    items = Items(list(enumerate(passages)), words, budget)
    a = ahocorasick.Automaton()
    for p in items.pieces:
        a.add_word(p, p)
    a.make_automaton()
    return lambda text: items.leaks(a.iter, words_of(text))


PASSAGE = "The clerk of Ardlow collected the foreign teapot within a fortnight, although Holgarert had mislaid a damp mirror"


def test_leaks_through_dirt_and_with_an_error():
    find = searcher([PASSAGE])
    dirty = PASSAGE.upper().replace("FOREIGN", "FOR-\n  EIGN").replace("WITHIN", "WITH\xadIN").replace(" ", "  ")
    assert find(f"before {dirty} after") == {0: 0}
    words = PASSAGE.split()
    assert find(" ".join(words[:15])) == {0: 0} and find(" ".join(words[:13])) == {}
    assert find(" ".join(words[:15]).replace("teapot", "teapt")) == {0: 1}
    assert find(" ".join(words[:15]).replace("teapot", "teaxpot")) == {0: 1}
    assert find(" ".join(words[:15]).replace("teapot", "teasot")) == {0: 1}
    assert find(" ".join(words[:15]).replace("teapot", "xxxx")) == {}
    assert find("x" + " ".join(words[:15]) + "y") == {0: 1}  # parts of longer words are no words


def test_recall_with_one_error_against_brute_force():
    rnd = random.Random(8)
    passages = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([15, 18, 30]))) for _ in range(12)]
    find = searcher(passages)
    runs_of = [["".join(words_of(p)[k : k + 15]) for k in range(len(words_of(p)) - 14)] for p in passages]
    held = 0
    for n in range(150):
        p = rnd.choice(passages).split()
        k = rnd.randrange(len(p) - 14)
        run = list(" ".join(p[k : k + 15]))
        for _ in range(rnd.choice([0, 1, 1, 1, 2])):
            at = rnd.randrange(len(run))
            run[at : at + 1] = rnd.choice([[], [run[at], "q"], ["q"]])
        text = " ".join(rnd.choice(WORDS) for _ in range(10)) + " " + "".join(run) + " " + " ".join(rnd.choice(WORDS) for _ in range(10))
        body = "".join(words_of(text))
        want = {i: min(distance(r, body) for r in runs) for i, runs in enumerate(runs_of)}
        got = find(text)
        assert {i for i, d in want.items() if d <= 1} == set(got), (n, want, got)
        assert all(max(want[i], 0) <= d <= 1 for i, d in got.items())
        held += bool(got)
    assert held > 90


def test_repair():
    assert repair("l’expert a relevÃ© dÃ©fauts") == "l’expert a relevé défauts"
    assert repair("Ã alone") == "Ã alone" and unwrap("ex-\r\n ample  a b") == "example a b"


TERMS = {"sport": ["goal nets", "race results", "club fees", "team doctors"], "energy": ["power cables", "gas meters", "heat pumps", "wind parks"], "media": ["film rights", "book covers", "song lyrics", "press photos"], "law": ["old deeds", "land titles", "court seals", "legal aids"]}
FRAMES = ["The dispute concerns {0}, {1} and {2}, which the claimant wants back.", "The court finds that {0} and {1} were defective, whereas {2} gave no cause.", "The expert examined {0} and recorded faults that were traced to {1}."]


def passage(rnd, subject, terms):
    return " ".join(f.format(*rnd.sample(terms[subject], 3)) for f in rnd.sample(FRAMES, 2))


# asides in words of their own: what tells them is the case that they cite, or that a term stands alone
ASIDES = [
    "By contrast, Holm v Marsh (1999) 12 Abc. Rep. 44 was all about {0}, {1} and {2}.",
    "A different chamber considered {0}, {1} and {2} at length in ABC 87/86, § 4.",
    "See also [1979] QRS 152, [12] on {0}, {1} and {2}.",
    "Our colleagues heard of {0}, {1} and {2} in Re Smith Estate, 1984 Tarn. L.R. 29.",
    "One is reminded of the law on {0}, though nobody said why.",
]


def rulings(rnd, n):
    docs, want = [], {}
    for d in range(n):
        subjects = rnd.sample(sorted(TERMS), rnd.choice([0, 1, 1, 2]))
        other = rnd.choice([s for s in TERMS if s not in subjects])
        parts = [passage(rnd, s, TERMS) for s in subjects] + ["The claim form was served in time.", rnd.choice(ASIDES).format(*rnd.sample(TERMS[other], 3))]
        rnd.shuffle(parts)
        docs.append((d, f"Court of Holm, F {d % 50}/21\n" + "\n".join(f"{i}. {p}" for i, p in enumerate(parts)), f"F {d % 50}/21"))
        want[d] = set(subjects)
    return docs, want


def test_subjects_on_held_out_rulings(spark):
    rnd = random.Random(4)
    known = {s: t[:3] for s, t in TERMS.items()}  # one term of each subject is in no passage
    examples = spark.createDataFrame([(passage(rnd, s, known), s) for s in TERMS for _ in range(12)], "text string, subject string")
    docs, want = rulings(rnd, 400)
    docs += [(1000, None, None), (1001, "", "x"), (1002, "  .. ", "x"), (1003, "İ" * 20, None), (1004, "power cables " * 50_000, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, docket_no string").selectExpr("*", "'x' as subject", "0 as score")
    got = {d: set() for d in want}
    rows = document_subjects(df, examples).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got[d] == want[d] for d in want)
    assert right / len(want) > 0.97, right
    assert not any(d in got for d in (1000, 1001, 1002, 1003))
    # a corpus and its ten-fold repetition give the same rows: nothing depends on the number of texts
    ten = df.join(spark.range(10).selectExpr("id as copy"), how="cross").selectExpr("doc_id + copy * 10000 as doc_id", "text", "docket_no")
    many = document_subjects(ten, examples).collect()
    assert {(r.doc_id % 10000, r.subject) for r in many} == {(r.doc_id, r.subject) for r in rows} and len(many) == 10 * len(rows)
    assert document_subjects(df.limit(0), examples).count() == 0
    assert document_subjects(df, examples.limit(0)).count() == 0


def test_blocks_of_terms_change_nothing(spark, monkeypatch):
    import barloom.llm.subjects as subjects

    rnd = random.Random(6)
    examples = spark.createDataFrame([(passage(rnd, s, TERMS), s) for s in TERMS for _ in range(12)], "text string, subject string")
    df = spark.createDataFrame(rulings(rnd, 60)[0], "doc_id long, text string, docket_no string")
    one = {tuple(r) for r in document_subjects(df, examples).collect()}
    monkeypatch.setattr(subjects, "BLOCK", 5)
    monkeypatch.setattr(subjects, "FLUSH", 3)
    assert {tuple(r) for r in document_subjects(df, examples).collect()} == one and one


def test_mentions():
    lex = seed_lexicon([(passage(random.Random(i), s, TERMS), s) for s in TERMS for i in range(12)])
    automata = [lex.automaton()]
    count = lambda text, own=None: [{s: len(m) for s, m in found.items()} for *_, found in scan(sentences(text), automata, own)]
    assert count("We saw power cables and gas meters.") == [{"energy": 2}]
    assert count("We saw power cables.") == [] and count("We met Power Cables and Gas Meters.") == []  # one mention; names
    assert count("In F 2/21 we saw power cables and gas meters.") == [] and count("In F 2/21 we saw power cables and gas meters.", "F 2/21") == [{"energy": 2}]
    assert count("We saw empowered cables-free gas meterss.") == []


def test_thresholds_of_real_passages(spark):
    path = "/root/testdata/sf0.01/subject_examples.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = subject_thresholds(spark.read.parquet(path)).collect()
    assert len(rows) == 10
    for r in rows:  # on passages that the lexicon hasn't seen; the corpus adds terms
        assert r.threshold > 0 and r.precision >= 0.95 and r.recall >= 0.85, r
    assert calibrate([]) == {} and calibrate([("a", "x")]) == {"x": (0.0, 0.0, 0.0)}
