import numpy as np
import pytest
from pyspark.sql import functions as F

from cstloom.llm import documentation as doc

GOOD = ["Reads the file once.", "/** Liefert den letzten Eintrag zum Hafen. */", "# Blocks for at most 4 ms.", "loadFile: Drops entries it can't explain.", "/**\n * TODO\n * Waits until the queue has settled.\n * @param a the a\n */", "/// <summary>\n/// Walks the tree.\n/// </summary>"]
BAD = [None, "", "  ", "TODO", "// FIXME: later", "/** ... */", "-----", "/** @param a the a */", ":param x: the x", "noqa", "# pragma: no cover", "x = loadFile(y)", "return a + b;", "Load file.", "The load file function.", "loadFile", "// @inheritDoc", "See above.", '""""""', "N/A", "Auto-generated method stub", "/**\n * ====\n */"]


@pytest.mark.parametrize("text", GOOD)
def test_telling(text):
    assert doc.says_something(text, "loadFile")


@pytest.mark.parametrize("text", BAD)
def test_not_telling(text):
    assert not doc.says_something(text, "loadFile")


def test_python_docstring():
    assert doc.python_docstring("def f(a=')',\n      b=[1]):\n    # note\n    '''Says\n    it.'''\n") == "Says\n    it."
    assert doc.python_docstring("def f():\n    return 'x'\n") is None
    assert doc.python_docstring("x = 1") is None


FILE = "# Not for g.\n\n# Gives the sum of both.\n@cache\ndef f(a, b):\n    return a + b\n\ndef g():\n    '''Does it all at once.'''\n\n# only\ndef h(x):\n    # inner words that say much about it\n    return x\n"


def test_links(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "file", "a.py", 1, FILE, None), (2, 1, "function_definition", "f", 5, "def f(a, b):\n    return a + b", None), (3, 1, "function_definition", "g", 8, "def g():\n    '''Does it all at once.'''\n", None), (4, 1, "function_definition", "h", 12, "def h(x):\n    # inner words that say much about it\n    return x", ""),
         (5, 2, "method_declaration", "k", 3, None, "Tells the time of day."), (6, 2, "class_definition", "C", 1, "class C", "A class that is documented."), (2, 1, "function_definition", "f", 5, "def f(a, b):\n    return a + b", None), (7, None, "function_item", None, None, "// Moves all of them.\nfn k() {}", None)],
        "chunk_no bigint, file_id bigint, chunk_type string, name string, line_start int, text string, docstring string",
    )
    got = {r.chunk_no: r for r in doc.documented(chunks).collect()}
    assert set(got) == {2, 3, 5, 7} and "sum of both" in got[2].documentation and got[3].source == "inner"
    crlf = chunks.selectExpr("chunk_no", "file_id", "chunk_type", "name", "line_start", "replace(text, '\n', '\r\n') as text", "docstring")
    assert {r.chunk_no for r in doc.documented(crlf).collect()} == {2, 3, 5, 7}
    assert doc.pairs(chunks).count() == 4 and doc.documented(chunks.limit(0)).count() == 0


def test_best_assignment_against_brute_force():
    rng = np.random.default_rng(4)

    def brute(links, own, free):
        if not links:
            return 0.0
        (u, some), rest = links[0], links[1:]
        return max([own[u] + brute(rest, own, free)] + [w + brute(rest, own, free - {c}) for c, w in some if c in free])

    for _ in range(200):
        n, m = rng.integers(1, 7, 2)
        links = {u: [(c, float(rng.integers(1, 9))) for c in range(m) if rng.random() < 0.6] for u in range(n)}
        own = {u: float(rng.integers(0, 5)) for u in range(n)}
        got = doc.best_assignment(links, own)
        assert len(set(got.values())) == len(got)
        value = sum(dict(links[u])[got[u]] if u in got else own[u] for u in links)
        assert value == brute(list(links.items()), own, frozenset(range(m)))


RIVALS = "# Tells who can reach(gate) and drop(bolt).\n# :param bolt: what falls\ndef drop(bolt): return bolt\ndef reach(gate): return gate\n"


def test_assignment_beats_greedy(spark):
    """Greedy gives the heavier function both its choices and the other one nothing."""
    assert doc.best_assignment({1: [(10, 3.5), (11, 3.0)], 2: [(10, 3.25)]}, {}) == {1: 11, 2: 10}
    links = spark.createDataFrame([(1, 5, 10, 12, 3.5, 0.0), (1, 5, 11, 12, 3.0, 0.0), (2, 5, 10, 13, 3.25, 0.0), (3, 5, 90, 91, 2.5, 0.0), (4, 6, 10, 12, 2.5, 0.0), (5, 6, 10, 12, 2.5, 1.0), (6, 5, 40, 42, 2.5, 0.0), (7, 5, 40, 43, 3.0, 2.8)], "chunk_no bigint, file_id bigint, at int, line_start int, weight double, own double")
    assert {(r.chunk_no, r.at) for r in doc.assigned(links).collect()} == {(1, 11), (2, 10), (3, 90), (4, 10), (6, 40)}
    chunks = spark.createDataFrame([(1, 1, "file", "a.py", 1, RIVALS, None), (2, 1, "function_definition", "drop", 3, "def drop(bolt): return bolt", "Lets the bolt fall to the floor."), (3, 1, "function_definition", "reach", 4, "def reach(gate): return gate", None)], "chunk_no bigint, file_id bigint, chunk_type string, name string, line_start int, text string, docstring string")
    assert {r.chunk_no for r in doc.documented(chunks.replace(":param bolt: what falls", ":param gate: what opens")).collect()} == {2}
    got = {r.chunk_no: r.source for r in doc.documented(chunks.withColumn("text", F.replace("text", F.lit(":param bolt: what falls"), F.lit(":param gate: which one")))).collect()}
    assert got == {2: "docstring", 3: "above"}


def test_distance_and_decorations():
    text = "# Far words of the file.\n\n@wrap(\n    1,\n)\n\ndef f(): pass\n"
    assert doc.file_comments(text) == [(1, [(3, 1), (4, 1), (5, 1), (7, 2)], "# Far words of the file.")]
    assert doc.file_comments("# Says it.\ndef f(): pass\ndef g(): pass\n\ndef h(): pass\n") == [(1, [(2, 0), (3, 1)], "# Says it.")]


def test_classes_take_their_comments(spark):
    text = "# Holds the words of run and all their uses.\nclass A:\n    def run(self):\n        return 1\n"
    rows = [(1, 1, "file", "a.py", 1, text, None), (2, 1, "class_definition", "A", 2, "class A:", None), (3, 1, "function_definition", "run", 3, "def run(self):\n        return 1", None)]
    chunks = spark.createDataFrame(rows, "chunk_no bigint, file_id bigint, chunk_type string, name string, line_start int, text string, docstring string")
    assert doc.documented(chunks).count() == 0 and doc.documented(chunks.filter("chunk_no <> 2")).count() == 1
