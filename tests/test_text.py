import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cstloom.functions import metadata as md
from cstloom.functions import text as tx
from cstloom.operators import vocabulary
from pyspark.sql import functions as F


def column(spark, texts, c):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(c).collect()]


TEXTS = [None, "", " ", "def getValue(x): # note\n  return 'a' + MAX_SIZE", "snake_case camelCase éa_b A AB ABC", "a //b\r\nc /* d\n e */ f", "x" * 70_000]


def test_tokens_match_word_boundaries(spark):
    want = [re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", t or "") for t in TEXTS]
    assert column(spark, TEXTS, tx.tokens("text")) == want


def test_identifiers(spark):
    got = column(spark, TEXTS, tx.identifiers("text"))
    assert got[0] == [] and got[3] == ["getValue", "max_size"] and got[4] == ["camelCase", "snake_case", "abc"]


def test_clean_text(spark):
    got = column(spark, TEXTS, tx.clean_text("text"))
    assert got[0] is None and got[5] == "a \nc  f" and "note" not in got[3]


def test_bigrams(spark):
    assert column(spark, ["alpha beta the gamma delta", "one", None], tx.bigrams(tx.tokens("text"))) == [["alpha_beta", "gamma_delta"], [], []]


def test_truncate(spark):
    assert [len(x) if x else x for x in column(spark, ["a" * 1000, "a" * 1001, None], tx.truncate("text"))] == [1000, 1000, None]


def ranked(spark, texts, vocabulary=(), context="", **more):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [[(k.keyword, k.score) for k in r.keywords] for r in tx.with_keywords(rows, "text", vocabulary, context, **more).orderBy("i").collect()]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=80), min_size=40, max_size=40), st.sampled_from(["", "file", "function_definition"]))
def test_keyword_scores_stay_in_bounds(spark, texts, context):
    for found in ranked(spark, texts, ["alpha"], context):
        assert len(found) <= 10 and all(0 <= s <= 2.8 for _, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert len({k.lower() for k, _ in found}) == len(found)


def test_keyword_score_by_hand(spark):
    # twice in the text, nine letters, known, camel case, at the beginning
    assert abs(dict(ranked(spark, ["parseFile parsefile"], ["unknown"])[0])["parseFile"] - (0.2 + 0.45 + 0.3 + 0.2)) < 1e-9
    # the known word comes first and stays as it is, without capitals
    assert abs(dict(ranked(spark, ["parseFile parsefile"], ["parsefile"])[0])["parsefile"] - (0.2 + 0.45 + 0.5 + 0.2)) < 1e-9
    # the pair isn't in the text as it is written, so it has no uses and no place
    assert abs(dict(ranked(spark, ["alpha gamma"])[0])["alpha_gamma"] - (0.5 + 0.3)) < 1e-9


def test_keyword_candidates(spark):
    got = ranked(spark, [None, "", " \n", "let x = 1", "fooBar fooBAr FOO_BAR AB return_value", "see // hiddenName\n'quotedName'"], context="file")
    assert got[:3] == [[], [], []] and {k for k, _ in got[3]} == {"package", "library"}  # module is a stop word
    assert got[4][0][0] == "fooBar" and "foo_bar" in dict(got[4]) and "fooBAr" not in dict(got[4]) and "ab" not in dict(got[4])
    assert {"hiddenName", "quotedName"} <= set(dict(got[5]))  # names come from the raw text, words from the cleaned one
    # a context that a keyword holds counts, equal scores keep the order of the candidates
    assert [k for k, _ in ranked(spark, ["zz yy xx"], ["xx", "yy", "zz"])[0]][:3] == ["zz", "yy", "xx"]
    assert len(ranked(spark, [" ".join(f"wordNumber{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))])[0]) == 10


def test_occurrences(spark):
    rows = spark.createDataFrame([("aaaa ana banana", ["a", "aa", "ana", "nan", "zz", "banana"]), (None, ["a"]), ("x", None), ("", ["a"])], "t string, w array<string>")
    got = [[tuple(x) for x in r[0]] for r in rows.select(tx.occurrences("t", "w")).collect()]
    assert got == [[(t.count(w), t.find(w)) for t in ["aaaa ana banana"] for w in ("a", "aa", "ana", "nan", "zz", "banana")], [], [], [(0, -1)]]


def test_tagger(spark):
    tagger = lambda texts: [[(w, "NN" if w.startswith("n") else "DT") for w in t.split()] for t in texts]
    # once in the text, six letters, at the eighth of sixteen places; "no" is too short
    assert ranked(spark, ["of the needle no"], tagged=tx.pos_tags("text", tagger))[0][-1] == ("needle", round(0.1 + 0.3 + 0.2 - 0.2 * 7 / 16, 9))


def test_metadata(spark):
    rows = spark.createDataFrame([(None,), ([],), (["", " "],), (["a ", " b"],), (["a | b"],)], "k array<string>")
    assert [r[0] for r in rows.select(md.joined("k")).collect()] == [None, None, "", "a | b", "a | b"]
    assert rows.select(md.split_again(md.joined("k"))).collect()[3][0] == ["a", "b"]
    flat = rows.select(md.flattened({"s": F.lit(" x "), "e": F.lit(" "), "z": F.lit(None).cast("string")}, {"k": F.col("k")}, {"n": F.lit(1)})).collect()
    assert flat[0][0] == {"s": "x", "n": "1"} and flat[3][0] == {"s": "x", "k": "a | b", "n": "1"}
    assert md.collection_name("all-mpnet-base-v2.1") == "codebase_all_mpnet_base_v2_1"


def test_extract_code(spark):
    assert column(spark, ["Type: x\nCode:\nfoo\nCode:\nbar", "no code", None], md.extract_code("text")) == ["foo\nCode:\nbar", "no code", None]


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha", "x"), (2, "alpha beta", "x"), (3, "gamma", "x"), (4, None, "x"), (5, " ", "x")], "doc_id bigint, text string, term string")
    assert sorted((r.term, r.tf, r.df) for r in vocabulary.tfidf_vocabulary(docs).collect()) == [("alpha", 3, 2), ("alpha beta", 2, 2), ("beta", 2, 2)]
    assert sorted((r.term, r.tf) for r in vocabulary.frequency_vocabulary(docs).collect()) == [("beta", 2)]
    assert vocabulary.vocabulary(docs.limit(0)) == []
    assert [r.terms for r in vocabulary.contained_terms(docs, ["beta", "eta"]).orderBy("doc_id").collect()] == [["beta", "eta"], ["beta", "eta"], [], [], []]
