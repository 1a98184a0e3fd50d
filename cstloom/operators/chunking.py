"""Chunks from labelled tree nodes: names, parents, dependencies, complexity, documentation, keywords, ids.

Works on the node table of ``operators.nested`` with file paths and languages.
The walk that labels the nodes also tells the units around each node and the
levels below it, so every step here is an equi-join on file_id and a node's number
or an aggregation, never a search in ranges.  Files without nodes give nothing;
blank units are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cstloom.functions import text as tx
from cstloom.functions.words import SEMANTIC_TYPES
from cstloom.operators import nested, vocabulary
from cstloom.session import reliable

IMPORTS, CALLS = ["import_statement", "import_from_statement"], ["call_expression", "function_call"]
#: The columns of a node that chunks are made of.
COLUMNS = ["file_id", "pre", "last", "parent_pre", "depth", "ord", "type", "text", "start_byte", "start_row", "end_row", "height", "units"]


def tree_nodes(records: DataFrame) -> DataFrame:
    """The labelled nodes of tree records, written once for all that chunks need of them."""
    return reliable(nested.flatten_trees(records, COLUMNS, SEMANTIC_TYPES))


def _units(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin(*SEMANTIC_TYPES))


def _by_unit(nodes: DataFrame, *columns: str) -> DataFrame:
    """(file_id, u_pre, *columns): the nodes once for every unit that holds them."""
    return nodes.select("file_id", F.explode("units").alias("u_pre"), *columns)


def complexity(nodes: DataFrame) -> DataFrame:
    """(file_id, pre, n_nodes, height, complexity): min(10, nodes / 10 + height / 5) of the subtree of each of the nodes given."""
    n = F.col("last") - F.col("pre") + 1
    return nodes.select("file_id", "pre", n.alias("n_nodes"), "height", F.least(F.lit(10.0), n / 10 + F.col("height") / 5).alias("complexity"))


def first_identifier(nodes: DataFrame) -> DataFrame:
    """(file_id, pre, name): the first identifier with a text in each unit, in preorder."""
    named = nodes.filter((F.col("type") == "identifier") & F.col("text").rlike(r"(?U)\S"))
    return _by_unit(named, "pre", "text").groupBy("file_id", "u_pre").agg(F.min_by(F.trim("text"), "pre").alias("name")).select("file_id", F.col("u_pre").alias("pre"), "name")


def nearest_parent(units: DataFrame) -> DataFrame:
    """(file_id, pre, parent_name) from units (file_id, pre, units, name): the innermost of these units around each one."""
    out = units.select("file_id", F.col("pre").alias("u_pre"), F.col("name").alias("o_name"))
    found = _by_unit(units, "pre").filter("u_pre < pre").join(out, ["file_id", "u_pre"]).groupBy("file_id", "pre").agg(F.max_by("o_name", "u_pre").alias("parent_name"))
    return units.select("file_id", "pre").join(found, ["file_id", "pre"], "left")


def import_name(text: Column) -> Column:
    """What an import statement names: its words without from and import, the first one, up to a dot."""
    bare = F.trim(F.replace(F.replace(F.trim(text), F.lit("from "), F.lit("")), F.lit("import "), F.lit("")))
    return F.split_part(F.split(bare, r"\s+")[0], F.lit("."), F.lit(1))


def import_dependencies(nodes: DataFrame) -> DataFrame:
    """(file_id, dependencies): sorted names of all imports of a file."""
    found = nodes.filter(F.col("type").isin(*IMPORTS) & F.col("text").rlike(r"(?U)\S"))
    return found.select("file_id", import_name(F.col("text")).alias("d")).groupBy("file_id").agg(F.array_sort(F.collect_set("d")).alias("dependencies"))


def call_dependencies(nodes: DataFrame) -> DataFrame:
    """(file_id, pre, calls): sorted names that each unit calls, the first identifier or member below each call."""
    calls = nodes.filter(F.col("type").isin(*CALLS)).select("file_id", F.col("pre").alias("c_pre"), "units")
    names = nodes.filter(F.col("type").isin("identifier", "member_expression")).select("file_id", F.col("parent_pre").alias("c_pre"), "ord", "text")
    called = calls.drop("units").join(names, ["file_id", "c_pre"]).groupBy("file_id", "c_pre").agg(F.min_by("text", "ord").alias("t"))
    within = calls.join(called, ["file_id", "c_pre"]).select("file_id", "units", F.split_part("t", F.lit("("), F.lit(1)).alias("called")).filter(F.col("called").isNotNull())
    return _by_unit(within, "called").groupBy("file_id", "u_pre").agg(F.array_sort(F.collect_set("called")).alias("calls")).select("file_id", F.col("u_pre").alias("pre"), "calls")


def docstrings(nodes: DataFrame, languages: DataFrame) -> DataFrame:
    """(file_id, pre, docstring): of a node's first three children the first string, comment or statement that documents it."""
    kids = nodes.filter(F.col("type").isin("string_literal", "comment", "expression_statement") & (F.col("ord") < 3) & F.col("parent_pre").isNotNull())
    kids = kids.join(languages.select("file_id", "language"), "file_id").withColumn("t", F.trim("text"))
    quoted = (F.col("language") == "python") & (F.col("t").startswith('"""') | F.col("t").startswith("'''"))
    doc = F.when(quoted, F.regexp_replace("t", r"^[\"']+|[\"']+$", "")).when(F.col("t").startswith("//") | F.col("t").startswith("/*"), F.col("t"))
    return kids.withColumn("d", doc).filter(F.col("d").isNotNull()).groupBy("file_id", F.col("parent_pre").alias("pre")).agg(F.min_by("d", "ord").alias("docstring"))


def summary(kind: Column, name: Column, parent: Column, docstring: Column) -> Column:
    line = F.regexp_replace(F.trim(F.split_part(F.coalesce(docstring, F.lit("")), F.lit("\n"), F.lit(1))), r"^[\"'/*]+|[\"'/*]+$", "")
    return F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(": "), name, F.when(parent.isNotNull() & (parent != ""), F.concat(F.lit(" (in "), parent, F.lit(")"))).otherwise(""), F.when((line != "") & (F.length(line) < 100), F.concat(F.lit(" - "), line)).otherwise(""))


def chunk_id(path: Column, kind: Column, name: Column, line: Column, start_byte: Column) -> Column:
    key = F.concat_ws(":", path, kind, name, line.cast("string"), start_byte.cast("string"))
    return F.concat(F.concat_ws(":", path, kind, name, line.cast("string")), F.lit("_"), F.substring(F.md5(key), 1, 8))


def unique_ids(chunks: DataFrame, order: list[str], path: str = "filepath", text: str = "text") -> DataFrame:
    """Repeated ids repaired: the first stays, later ones get a hash of path and text, and a number where that repeats too."""
    w = Window.partitionBy("id").orderBy(*order)
    hashed = F.concat(F.col("id"), F.lit("_"), F.substring(F.md5(F.concat(F.col(path), F.lit(":"), F.substring(F.coalesce(text, F.lit("")), 1, 100))), 1, 8))
    first = chunks.withColumn("_n", F.row_number().over(w)).withColumn("_id", F.when(F.col("_n") == 1, F.col("id")).otherwise(hashed))
    again = Window.partitionBy("_id").orderBy(*order)
    return first.withColumn("_m", F.row_number().over(again)).withColumn("id", F.when(F.col("_m") == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("_"), (F.col("_m") - 1).cast("string")))).drop("_n", "_m", "_id")


def chunks_of(nodes: DataFrame, files: DataFrame, vocab: Iterable[str] = (), tagger=None) -> DataFrame:
    """Chunks of all units of files (file_id, filepath, language): the file chunk and one for each function, class and the like.

    nodes: see ``tree_nodes``; vocab: a bounded list of the corpus's terms, see
    ``corpus_vocabulary``; tagger: see ``functions.text.pos_tags``.
    """
    units = _units(nodes).filter(F.col("text").rlike(r"(?U)\S"))
    named = units.join(first_identifier(nodes), ["file_id", "pre"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("anonymous_"), "type")))
    parents = nearest_parent(named.select("file_id", "pre", "units", "name"))
    deps = import_dependencies(nodes)
    docs = docstrings(nodes, files)
    sized = complexity(named.select("file_id", "pre", "last", "height")).select("file_id", "pre", "complexity")
    full = named.drop("height").join(parents, ["file_id", "pre"]).join(sized, ["file_id", "pre"]).join(call_dependencies(nodes), ["file_id", "pre"], "left").join(docs, ["file_id", "pre"], "left").join(files, "file_id").join(deps, "file_id", "left")
    none = F.array().cast("array<string>")
    line = F.col("start_row") + 1
    unit = full.select(
        chunk_id(F.col("filepath"), F.col("type"), F.col("name"), line, F.col("start_byte")).alias("id"), "file_id", "filepath", F.col("type").alias("chunk_type"), "language", "name", "parent_name",
        line.alias("line_start"), (F.col("end_row") + 1).alias("line_end"), "text", summary(F.col("type"), F.col("name"), F.col("parent_name"), F.col("docstring")).alias("summary"),
        F.array_sort(F.array_union(F.coalesce("dependencies", none), F.coalesce("calls", none))).alias("dependencies"), F.col("complexity").alias("complexity_score"), "docstring", "pre", F.col("name").alias("_named"),
    )
    base = F.element_at(F.split("filepath", "/"), -1)
    tops = nodes.filter(F.col("pre") == 0)
    roots = tops.select("file_id", "text", "pre").join(complexity(tops).select("file_id", "complexity"), "file_id").join(docs, ["file_id", "pre"], "left").join(files, "file_id").join(deps, "file_id", "left")
    used = F.when(F.size("dependencies") > 0, F.concat(F.lit(" - imports: "), F.array_join(F.slice("dependencies", 1, 5), ", "))).otherwise("")
    whole = roots.select(
        F.concat(F.lit("file:"), "filepath").alias("id"), "file_id", "filepath", F.lit("file").alias("chunk_type"), "language", base.alias("name"), F.lit(None).cast("string").alias("parent_name"),
        F.lit(1).cast("bigint").alias("line_start"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("line_end"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("File "), base, F.lit(" ("), "language", F.lit(")"), used).alias("summary"),
        F.coalesce("dependencies", none).alias("dependencies"), F.col("complexity").alias("complexity_score"), "docstring", "pre", F.col("filepath").alias("_named"),
    )
    made = unique_ids(whole.unionByName(unit), ["file_id", "pre", "chunk_type"]).drop("pre")
    return keyworded(made, vocab, tagger=tagger).drop("_named")


def keyworded(chunks: DataFrame, vocab: Iterable[str] = (), named: str = "_named", tagger=None) -> DataFrame:
    """Adds keywords, sorted: the best ones of name and text together, and the terms of the vocabulary that the text holds.

    Only the type ``file`` is a context with terms of its own.
    """
    vocab = list(vocab)
    both = chunks.withColumn("_both", F.concat_ws(" ", F.when(F.col(named) != "", F.col(named)), F.coalesce("text", F.lit(""))))
    tagged = tx.pos_tags(tx.clean_text("_both"), tagger) if tagger is not None else None
    ranked = tx.with_keywords(both, "_both", vocab, F.col("chunk_type"), name="_ranked", tagged=tagged)
    held = tx.contained("text", vocab) if vocab else F.array().cast("array<string>")
    words = ranked.withColumn("_held", held).withColumn("_best", F.transform("_ranked", lambda k: k["keyword"]))
    return words.withColumn("keywords", F.array_sort(F.array_union("_best", "_held"))).drop("_both", "_ranked", "_held", "_best")


def corpus_vocabulary(nodes: DataFrame) -> list[str]:
    """The vocabulary over the texts of all files, the pass before chunking."""
    return vocabulary.vocabulary(nodes.filter((F.col("pre") == 0) & F.col("text").rlike(r"(?U)\S")), "file_id", "text")
