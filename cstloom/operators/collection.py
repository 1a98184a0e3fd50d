"""Collections of embedded chunks: embedding, checks, writing, reading, searching.

A collection is a Parquet table (id, embedding, document, metadata, language,
chunk_type) in one folder for each model, partitioned by language and batch.  The embedder
is a plug-in; the default hashes words into a unit vector, which is a vector
space of its own.  Rows that can't be stored go to a reject table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.functions import metadata as md
from cstloom.functions.text import truncate
from cstloom.operators import vectors

DIMENSION = 384
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """Signed counts of hashed words, of unit length; a text without words gives the zero vector."""
    out = []
    for text in texts:
        v = [0.0] * dimension
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % dimension] += 1.0 if h & 0x80000000 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def embed(text: str | Column, embedder: Embedder = hashing_embedder, batch: int = 32) -> Column:
    """Vectors of texts, in batches, the model loaded once in each worker by the embedder itself."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(texts), batch) for v in embedder(texts[at : at + batch])])

    return run(F.col(text) if isinstance(text, str) else text)


def prepare(chunks: DataFrame, embedder: Embedder = hashing_embedder) -> DataFrame:
    """Rows of a collection from chunks (id, text, chunk_type, language, filepath, name, ...)."""
    c = F.col
    document = md.enhanced_text(c("summary"), c("chunk_type"), c("language"), c("name"), c("parent_name"), c("keywords"), c("dependencies"), c("text"))
    meta = md.flattened({k: c(k) for k in ("chunk_type", "language", "filepath", "name", "parent_name", "summary", "docstring")}, {k: c(k) for k in ("keywords", "dependencies")}, {k: c(k) for k in ("line_start", "line_end", "complexity_score")})
    rows = chunks.select("id", document.alias("document"), meta.alias("metadata"), "language", "chunk_type")
    return rows.withColumn("embedding", embed("document", embedder))


def split_rejects(rows: DataFrame, dimension: int = DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and those that can't with the reason."""
    bad = F.when(F.col("id").isNull(), "no id").when(F.col("embedding").isNull() | (F.size("embedding") != dimension), "wrong dimension").when(F.exists("embedding", lambda x: F.isnan(x) | x.isNull()), "not a number")
    judged = rows.withColumn("reason", bad)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


#: The batch of rows that a load writes; streams number theirs from 0.
LOADED = -1


def write(rows: DataFrame, folder: str, model: str, append: bool = False, batch: int = LOADED) -> str:
    """Replace (or extend) a model's collection; returns its folder.

    Loads and streams share one layout, language and below it batch.  A batch of a
    stream replaces the rows of its own number and leaves all others.
    """
    path = f"{folder}/{md.collection_name(model)}"
    writer = rows.withColumn("batch", F.lit(batch)).write.partitionBy("language", "batch")
    if batch != LOADED:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if append else "overwrite").parquet(path)
    return path


def open_collection(spark: SparkSession, folder: str, model: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{md.collection_name(model)}").drop("batch")


def search(collection: DataFrame, query: str, k: int = 5, language: str | None = None, chunk_type: str | None = None, embedder: Embedder = hashing_embedder) -> DataFrame:
    """(rank, id, similarity, distance, code, document, metadata) of the nearest chunks; both filters apply if both are given."""
    near = vectors.top_k(collection, embedder([query])[0], k, "id", where=vectors.metadata_filter(language, chunk_type), carry=["document", "metadata"])
    return near.select("rank", "id", "similarity", "distance", md.extract_code("document").alias("code"), "document", "metadata").orderBy("rank")


def displayed_briefly(hits: DataFrame, most: int = 300) -> DataFrame:
    """Hits as the plain search prints them: what they are, and the document cut to a preview."""
    m = F.col("metadata")
    return hits.select("rank", "id", F.round("similarity", 4).alias("similarity"), F.round("distance", 4).alias("distance"), *[m[c].alias(c) for c in ("name", "chunk_type", "language", "filepath")], truncate("document", most).alias("preview"))


def displayed(hits: DataFrame, lines: int = 10) -> DataFrame:
    """Hits as they are printed: eight keywords and how many more, five dependencies, the first lines of the code."""
    kw, deps = md.split_again(F.col("metadata")["keywords"]), md.split_again(F.col("metadata")["dependencies"])
    more = F.when(F.size(kw) > 8, F.concat(F.lit(" (+"), (F.size(kw) - 8).cast("string"), F.lit(" more)"))).otherwise("")
    return hits.select("rank", "id", F.round("similarity", 4).alias("similarity"), F.concat(F.array_join(F.slice(kw, 1, 8), ", "), more).alias("keywords"), F.array_join(F.slice(deps, 1, 5), ", ").alias("dependencies"), F.array_join(F.slice(F.split("code", "\n"), 1, lines), "\n").alias("preview"))


CHUNK = "id string, filepath string, chunk_type string, language string, name string, parent_name string, line_start bigint, line_end bigint, text string, summary string, keywords array<string>, dependencies array<string>, complexity_score double, docstring string"


def write_chunks(chunks: DataFrame, folder: str, source: str) -> None:
    """Chunks as JSON lines, and a one-row summary beside them."""
    chunks.write.mode("overwrite").json(f"{folder}/chunks")
    counts = read_chunks(chunks.sparkSession, folder).groupBy("chunk_type").count()
    summary = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_chunks"), F.map_from_entries(F.collect_list(F.struct("chunk_type", "count"))).alias("chunk_types"))
    summary.select("*", F.lit(source).alias("source_file"), F.unix_micros(F.current_timestamp()).cast("double").alias("generated_at")).withColumn("generated_at", F.col("generated_at") / 1e6).write.mode("overwrite").json(f"{folder}/summary")


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK, documents: bool = False) -> DataFrame:
    """The chunks that write_chunks wrote, or those of whole documents {chunks: [...]}, whose fields may stand in a metadata object."""
    if not documents:
        return spark.read.schema(schema).json(f"{path}/chunks")
    inner = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    whole = spark.read.schema(f"chunks array<struct<{inner}, metadata: struct<{inner}>>>").json(path, multiLine=True).select(F.inline("chunks"))
    return whole.select(*[F.coalesce(F.col(n), F.col("metadata")[n]).alias(n) for n in (c.split()[0] for c in schema.split(", "))])
