import numpy as np
import pandas as pd
import pytest

from cstloom.llm import abuse

WORDS = "the parser reads every line of a file and keeps order until queue is closed again for now".split()
RUDE = ["you are a worthless idiot", "shut up you pathetic moron", "nobody likes you idiot", "those people are vermin"]
KIND = ["that was a stupid mistake of mine", "kill the child process first", "the word filter must catch idiot", "garbage in the buffer is ignored"]


def sample(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        body = [" ".join(rng.choice(WORDS, 9)) + "." for _ in range(rng.integers(1, 6))]
        kind = i % 4
        if kind == 0:
            body.insert(rng.integers(0, len(body) + 1), RUDE[i // 4 % 4] + ".")
        elif kind == 1:
            body.insert(rng.integers(0, len(body) + 1), KIND[i // 4 % 4] + ".")
        rows.append((i, " ".join(body), "en" if i % 3 else None, float(kind == 0 and i // 4 % 4 < 3), float(kind == 0 and i // 4 % 4 == 3), 0.0))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", *abuse.CATEGORIES])


def test_held_out_accuracy_with_noise(monkeypatch):
    monkeypatch.setattr(abuse, "STEPS", 300)
    train, test = sample(600, 1), sample(200, 2)
    noise = np.random.default_rng(3).random(600) < 0.06
    train.loc[noise, "abusive"] = 1 - train.loc[noise, "abusive"]
    judge = abuse.train(train)
    texts = test["text"].tolist()
    flags = judge.flags(judge.score(texts), test["lang"].tolist())
    truth = test[list(abuse.CATEGORIES)].max(axis=1).to_numpy() > 0.5
    assert (flags == truth).mean() > 0.95
    spelled = [t.replace("idiot", "1d10t").replace("moron", "m o r o n").replace("vermin", "ver​min").upper() for t in texts]
    assert (judge.flags(judge.score(spelled), test["lang"].tolist()) == truth).mean() > 0.93
    assert judge.score([None, "", "  "]).tolist() == [[0, 0, 0]] * 3


def test_normal_forms():
    assert len({abuse.normal(w) for w in ("idiot", "IDIOT", "1d10t", "idiiiiot", "ïdîot")}) == 1
    assert abuse.words_of("c l o w n") == abuse.words_of("clown") == abuse.words_of("cl​own")


@pytest.mark.parametrize("few", [0, 3])
def test_tables(spark, monkeypatch, few):
    monkeypatch.setattr(abuse, "STEPS", 20)
    docs = spark.createDataFrame([(1, "you idiot", "en", "r", 1.0), (2, None, None, None, 1.0), (3, "", "en", "r", 1.0), (4, "fine " * 20_000, "en", "r", 1.0)], "doc_id bigint, text string, lang string, source string, abusive double")
    labels = spark.createDataFrame([(1, "a", "abusive"), (1, "a", "abusive"), (4, "a", "none"), (4, "b", None)][: few or 0] or [(9, "a", None)], "doc_id bigint, annotator string, label string")
    terms = spark.createDataFrame([("idiot", "abusive"), (None, "sexual"), ("x", "other")], "term string, category string")
    got = {r.doc_id: r for r in abuse.scored(docs, labels, terms).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2].abusive == 0 and not got[3].flagged
    assert abuse.rates(abuse.scored(docs, labels, terms)).count() == 2
    assert abuse.scored(docs.limit(0), labels, terms).count() == 0


@pytest.mark.parametrize("labels", [[], [(4, "a", "none")], [(1, "a", "abusive")]])
def test_the_list_decides_without_labels_of_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "you 1diot", "en", "r"), (2, "nackt fotos von dir", "de", "r"), (3, "nackt", "de", "r"), (4, "fine " * 200, "en", "r"), (5, None, None, None)], "doc_id bigint, text string, lang string, source string")
    terms = spark.createDataFrame([("idiot", "abusive"), ("nackt fotos", "sexual"), ("fine", "other"), (None, "sexual")], "term string, category string")
    got = {r.doc_id: r for r in abuse.scored(docs, spark.createDataFrame(labels, "doc_id bigint, annotator string, label string"), terms).collect()}
    assert {i for i, r in got.items() if r.flagged} == {1, 2} and got[1].abusive == 1 and got[2].sexual == 1 and len(got) == 5


def test_listed_words_that_no_labelled_document_uses(monkeypatch):
    monkeypatch.setattr(abuse, "STEPS", 300)
    terms = pd.DataFrame({"term": ["scumbag", "connard"], "category": ["abusive", "abusive"]})
    judge = abuse.train(sample(400, 1), terms)
    rows = judge.vocabulary.rows(abuse.words_of("scumbag connard unheard"))
    assert (rows[:2] > 0).all() and rows[2] == 0
    scores = judge.score(["the parser reads every connard of a file", "the parser reads every unheard of a file"])
    assert scores[0, 0] > scores[1, 0]


def test_reader_agrees_with_whole_texts():
    texts = ["you i d i o t, a b", "x y. z", "c.l.o.w.n of", "a​b c\n\nd'e it's 1d10t!!", "", "\0 null\0s", "y a b.c d", "so\tI a\nb c", "fine " * 50, "A.B C"]
    vocabulary = abuse.Vocabulary(np.unique([h for t in texts for h in abuse.words_of(t)]))
    reader = abuse.Reader(vocabulary)
    for got, text in zip(reader.read(texts), texts):
        assert got.tolist() == vocabulary.rows(abuse.words_of(text.replace("\0", " "))).tolist()
    assert [len(r) for r in reader.read(texts)] == [len(r) for r in reader.read(texts)] and reader.read([]) == []


def test_words_far_apart_stay_apart():
    vocabulary = abuse.Vocabulary(np.unique(abuse.words_of("first second")))
    rows = abuse.Reader(vocabulary).read(["first " + "unheard " * 40 + "second"])[0]
    assert np.flatnonzero(rows).tolist() == [0, 41]
