"""Command lines over the library: parse, chunk, load, search, stats, graph."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from cstloom.operators import chunking, code_graph, collection, vectors
from cstloom.session import local_session, reliable
from cstloom.sources import files


def _parse(spark, a) -> None:
    parsed = files.parse_codebase(spark, a.input, recursive=not a.flat, most_bytes=a.max_bytes)
    parsed.write.mode("overwrite").parquet(a.output) if a.output else parsed.drop("text", "cst_json").show(truncate=False)


def _chunk(spark, a) -> None:
    parsed = spark.read.parquet(a.input).filter("success").withColumn("file_id", F.xxhash64("filepath")).withColumn("written_at", F.lit(None).cast("timestamp"))
    nodes = chunking.tree_nodes(parsed)
    made = chunking.chunks_of(nodes, parsed.select("file_id", "filepath", "language"), chunking.corpus_vocabulary(nodes))
    collection.write_chunks(made.drop("file_id"), a.output, a.input)


def _load(spark, a) -> None:
    began = time.time()
    chunk = collection.read_chunks(spark, a.input, documents=a.documents)
    rows = reliable(collection.prepare(chunk))
    good, bad = collection.split_rejects(rows)
    collection.write(good, a.db_path, a.model)
    bad.write.mode("overwrite").parquet(f"{a.db_path}/rejects")
    vectors.load_summary(rows.join(bad.select("id", F.lit(True).alias("bad")), "id", "left"), F.col("bad").isNull(), time.time() - began).show()


def _shown(hits, a) -> None:
    if a.brief:
        collection.displayed_briefly(hits).show(truncate=False)
    else:
        collection.displayed(hits, 1_000_000 if a.show_full else a.lines).show(truncate=False)


def _search(spark, a) -> None:
    rows = collection.open_collection(spark, a.db_path, a.model)
    if a.query is not None:
        _shown(collection.search(rows, a.query, a.k, a.language, a.type), a)
        return
    while (line := input("> ").strip()) not in ("", "quit", "exit"):
        query, language, kind = vectors.parse_query(line)
        _shown(collection.search(rows, query, a.k, language, kind), a)


def _stats(spark, a) -> None:
    rows = collection.open_collection(spark, a.db_path, a.model)
    vectors.collection_stats(rows).show()
    for group in ("language", "chunk_type"):
        vectors.sample_counts(rows, group, "id").orderBy(F.col("n").desc(), group).show()
    began = time.time()
    found = collection.search(rows, "function", 1).count()
    print(f"test query: {found} result(s) in {time.time() - began:.3f} s")


def _graph(spark, a) -> None:
    listed = spark.createDataFrame([(p, "python") for p, _ in files.list_files(a.input) if p.endswith(".py")], "path string, language string")
    facts = code_graph.facts(files.parse_files(listed).filter(F.col("text").isNotNull()))
    one_each = code_graph.upsert_edges(code_graph.edges(facts))
    code_graph.definitions(facts).write.mode("overwrite").json(f"{a.output}/chunks")
    code_graph.write_graphml(code_graph.upsert_nodes(code_graph.definitions(facts), one_each), one_each, f"{a.output}/graph.graphml")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cstloom")
    p.add_argument("--workers", default="8", help="cores of the local session")
    sub = p.add_subparsers(required=True)
    db = [("--model", {"default": "hashing"}), ("--db-path", {"default": "vectors"})]
    flag = {"action": "store_true"}
    commands = {
        "parse": (_parse, [("input", {}), ("--output", {}), ("--flat", flag), ("--max-bytes", {"type": int, "default": files.MOST_BYTES})]),
        "chunk": (_chunk, [("input", {}), ("output", {})]),
        "load": (_load, [("input", {}), ("--documents", flag), *db]),
        "search": (_search, [("--query", {}), ("--k", {"type": int, "default": 5}), ("--language", {}), ("--type", {}), ("--lines", {"type": int, "default": 10}), ("--show-full", flag), ("--brief", flag), *db]),
        "stats": (_stats, db),
        "graph": (_graph, [("input", {}), ("output", {})]),
    }
    for name, (run, options) in commands.items():
        s = sub.add_parser(name)
        for option, how in options:
            s.add_argument(option, **how)
        s.set_defaults(run=run)
    a = p.parse_args(argv)
    a.run(local_session(a.workers), a)


if __name__ == "__main__":
    main()
