"""Corpus vocabularies: uni- and bigrams with document bounds, or plain frequencies.

Both count over all documents.  Texts are cleaned first and blank ones left out.
Fewer than three documents leave no room between the bounds of the first kind,
which then gives way to the second.  An empty table gives an empty vocabulary.
The corpus is cleaned and counted in one pass: every document also counts for the
empty term, whose count is the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cstloom.functions import text as tx
from cstloom.functions.words import STOPWORDS
from cstloom.session import reliable


def _cleaned(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.lower(tx.clean_text(text)).alias("t")).filter(F.col("t").rlike(r"(?U)\S"))


def _counts(docs: DataFrame, key: str, text: str, pairs: bool) -> DataFrame:
    """(term, tf, df) of all words, of all pairs of words if asked, and of the empty term.

    A document's own counts come first, so that the shuffle by term carries one
    row for each term and partition.
    """
    words = _cleaned(docs, key, text).select("doc", tx.tokens("t").alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    two = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    terms = words.select("doc", F.explode_outer(F.concat("w", *([two] if pairs else []), F.array(F.lit("")))).alias("term"))
    return terms.groupBy("doc", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, tf, df) of all uni- and bigrams."""
    return _counts(docs, key, text, True).filter("term <> ''")


def valid_term() -> Column:
    """Every part longer than one character and no stop word."""
    return F.forall(F.split("term", " "), lambda p: (F.length(p) > 1) & ~p.isin(*STOPWORDS) & ~p.rlike("^[0-9]+$"))


def _with_documents(counted: DataFrame) -> DataFrame:
    """Adds the number of documents to the counts, which are written once and read twice."""
    counted = reliable(counted)
    return counted.filter("term <> ''").join(F.broadcast(counted.filter("term = ''").select(F.col("df").alias("docs"))))


def tfidf_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000, least_docs: int = 2, largest_share: float = 0.8) -> DataFrame:
    """(term, tf, df): the most frequent terms in at least least_docs documents and at most a share of them; validity is judged behind the cap."""
    kept = _with_documents(_counts(docs, key, text, True)).filter((F.col("df") >= least_docs) & (F.col("df") <= largest_share * F.col("docs")))
    return kept.orderBy(F.col("tf").desc(), "term").limit(most).filter(valid_term()).select("term", "tf", "df")


def frequency_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000) -> DataFrame:
    """(term, tf): of the 2 * most commonest valid words those with 1 < tf < 0.8 * documents, at most `most`."""
    top = _with_documents(_counts(docs, key, text, False)).filter(valid_term()).orderBy(F.col("tf").desc(), "term").limit(2 * most)
    return top.filter((F.col("tf") > 1) & (F.col("tf") < 0.8 * F.col("docs"))).orderBy(F.col("tf").desc(), "term").limit(most).select("term", "tf")


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000) -> list[str]:
    """At most `most` terms, as a list for closures; its size doesn't grow with the corpus."""
    if _cleaned(docs, key, text).limit(3).count() > 2:
        return [r.term for r in tfidf_vocabulary(docs, key, text, most).select("term").collect()]
    return [r.term for r in frequency_vocabulary(docs, key, text, most).select("term").collect()]


def contained_terms(texts: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms): the terms of a bounded list that occur anywhere in each text, in the order of the list."""
    return texts.select(key, tx.contained(text, terms).alias("terms"))
