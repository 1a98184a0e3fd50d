"""Queries of the core operators over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.functions import metadata as md
from cstloom.functions import text as tx
from cstloom.functions.words import SEMANTIC_TYPES
from cstloom.operators import chunking, code_graph, collection, nested, vectors, vocabulary
from cstloom.plans.nested_queries import QUERIES as NESTED
from cstloom.session import read_table
from cstloom.sources import files


def _t(name: str):
    return lambda spark, d: read_table(spark, d, name)


documents, embeddings, scans = _t("documents"), _t("embeddings"), _t("parse_results")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks, those delivered again once; a later delivery differs in nothing but its time."""
    return read_table(spark, d, "chunks").drop("loaded_at").dropDuplicates(["chunk_no"])


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    query = vectors.vector_of(e, F.col("vec_id") == 0)
    return vectors.top_k(e, query, 5).select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"), "rank")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    query = vectors.vector_of(e, F.col("vec_id") == 0)
    return vectors.top_k(e, query, 5, where=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    query = vectors.vector_of(e, F.col("vec_id") == 0)
    return vectors.top_k(e, query, 5, metric="cosine").select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    e = embeddings(spark, d)
    queries = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k_batch(e, queries, 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.collection_stats(embeddings(spark, d))


def sample_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return vectors.sample_counts(documents(spark, d), "lang", "doc_id")


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("language").agg(F.count("*").alias("n"))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("chunk_type").agg(F.count("*").alias("n"))


def parse_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.count_if(F.col("success").isNull()).alias("unknown"))


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    words = chunks(spark, d).select(F.explode("keywords").alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(10)


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.load_summary(_t("chunk_vectors")(spark, d), F.coalesce(F.size("embedding") == 64, F.lit(False)))
    return out.select("total", F.col("loaded").cast("bigint").alias("loaded"), F.col("failed").cast("bigint").alias("failed"), "loaded_percent")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.clean_text("text").alias("cleaned"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tokens("text")
    return documents(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    j = lambda c: F.array_join(c, " ")
    return documents(spark, d).select("doc_id", j(tx.camel_identifiers("text")).alias("camel"), j(tx.snake_identifiers("text")).alias("snake"), j(tx.const_identifiers("text")).alias("const"))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    pairs = documents(spark, d).select("doc_id", F.explode_outer(tx.bigrams(tx.tokens("text"))).alias("bigram")).filter(F.col("bigram").isNotNull())
    return pairs.groupBy("bigram").agg(F.count("*").alias("n"))


def vocab_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.tfidf_vocabulary(documents(spark, d))


def vocab_frequency(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.frequency_vocabulary(documents(spark, d))


def vocab_containment(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the whole vocabulary that occur in each document."""
    docs = documents(spark, d)
    terms = sorted(vocabulary.vocabulary(docs))
    return vocabulary.contained_terms(docs, terms).select("doc_id", F.array_join("terms", "|").alias("terms"))


def keyword_scores_top10(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    ranked = tx.with_keywords(docs.select("doc_id", "text"), "text", vocabulary.vocabulary(docs))
    # the filter that a plain posexplode brings along would repeat the whole pipeline
    return ranked.select("doc_id", F.posexplode_outer("keywords").alias("at", "k")).filter(F.col("k").isNotNull()).select("doc_id", (F.col("at") + 1).alias("rank"), F.col("k.keyword").alias("keyword"), F.round("k.score", 6).alias("score"))


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.truncate("text").alias("cut"))


def enhanced_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return chunks(spark, d).select("chunk_no", md.enhanced_text(c("summary"), c("chunk_type"), c("language"), c("name"), c("parent_name"), c("keywords"), c("dependencies"), c("text")).alias("document"))


def extract_code(spark: SparkSession, d: str) -> DataFrame:
    return enhanced_text(spark, d).select("chunk_no", md.extract_code("document").alias("code"))


def metadata_flatten(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_no", md.joined("keywords").alias("keywords"), md.joined("dependencies").alias("dependencies"), F.when(F.trim("docstring") != "", F.trim("docstring")).alias("docstring"))


def metadata_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return metadata_flatten(spark, d).select("chunk_no", F.array_join(md.split_again("keywords"), ",").alias("keywords"), F.size(md.split_again("keywords")).cast("bigint").alias("n"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return chunks(spark, d).select("chunk_no", chunking.chunk_id(c("filepath"), c("chunk_type"), c("name"), c("line_start"), c("line_end")).alias("made_id"))


def dedupe_ids(spark: SparkSession, d: str) -> DataFrame:
    """Repeated ids repaired; here each delivery of a chunk is a row of its own, as those are what repeats."""
    rows = read_table(spark, d, "chunks").select("id", "filepath", "text", "chunk_no", "loaded_at")
    return chunking.unique_ids(rows, ["chunk_no", "loaded_at"]).select("chunk_no", "id")


def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return vectors.batch_numbers(documents(spark, d).select("doc_id"), "doc_id", 100).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("filepath").distinct().filter(files.not_excluded(F.col("filepath")))


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    found = files.with_language(scans(spark, d).select(F.col("filepath").alias("path")).distinct())
    return found.select("path", "language")


def unsupported_files(spark: SparkSession, d: str) -> DataFrame:
    paths = scans(spark, d).select("filepath").distinct().withColumn("extension", files.extension(F.col("filepath")))
    return paths.join(F.broadcast(files.language_table(spark)), "extension", "left_anti").select("filepath", "extension")


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    trees = read_table(spark, d, "cst_documents")
    return trees, trees.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max("filepath").alias("filepath"), F.max("language").alias("language"))


def subtree_complexity(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.flatten_trees(_trees(spark, d)[0], ["file_id", "pre", "last", "type", "height"])
    return chunking.complexity(nodes.filter(F.col("type").isin(*SEMANTIC_TYPES)))


def tree_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all trees: names, parents, dependencies, complexity, keywords, summaries and repaired ids."""
    trees, paths = _trees(spark, d)
    nodes = chunking.tree_nodes(trees)
    return chunking.chunks_of(nodes, paths, chunking.corpus_vocabulary(nodes))


def _python_facts(spark: SparkSession, d: str) -> DataFrame:
    texts = chunks(spark, d).filter((F.col("chunk_type") == "file") & F.col("filepath").endswith(".py")).select("filepath", "text").distinct()
    return code_graph.facts(texts)


def python_defs(spark: SparkSession, d: str) -> DataFrame:
    return code_graph.definitions(_python_facts(spark, d))


def python_edges(spark: SparkSession, d: str) -> DataFrame:
    return code_graph.upsert_edges(code_graph.edges(_python_facts(spark, d)))


def graph_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Priority of a customer's orders by status: the last order wins."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("file"), F.col("o_orderkey").alias("seq"))
    return code_graph.upsert_edges(o)


def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as rows of a collection, embedded by the default embedder; rejects left out."""
    good, _ = collection.split_rejects(collection.prepare(chunks(spark, d)))
    return good.select("id", F.size("embedding").alias("dimension"), "document", "language", "chunk_type")


_FUNCTIONS = [
    vector_topk, vector_topk_filtered, vector_topk_cosine, vector_topk_batch, collection_stats, sample_group_counts, language_counts, type_counts, parse_outcomes, top_keywords, load_summary, clean_text, tokenize, identifiers, bigrams,
    vocab_tfidf, vocab_frequency, vocab_containment, keyword_scores_top10, truncate_text, enhanced_text, extract_code, metadata_flatten, metadata_roundtrip, chunk_ids, dedupe_ids, batch_assign, scan_filter, language_detect, unsupported_files,
    subtree_complexity, tree_chunks, python_defs, python_edges, graph_edge_upsert, embed_chunks,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS} | NESTED
