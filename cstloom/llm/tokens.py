"""Encoding whole corpora with a public byte-level BPE, and decoding again (problem 8).

Texts are split into words by the tokenizer's own pattern in the JVM.  Blocks of
documents hold their words as positions in a table of the block's distinct
words.  The distinct words of all blocks form one table, in which every distinct
word of the corpus is encoded once; its ids are joined back to the blocks and
from there to the documents by position.

A word crosses the network once for each block that uses it, however often it
occurs, so hot words and repeated texts cost no more than others; no block
grows beyond BLOCK_WORDS words and one document.

Defined results: an empty and a null text give the empty list; strings that
look like special tokens are ordinary text; an empty table gives an empty
table; other columns of the input are ignored; repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import importlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.session import reliable

#: The characters of the Unicode property White_Space and the split pattern of the tokenizer.
_WS = r"\u0009-\u000D \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD_PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words of a block, unless a single document has more.
BLOCK_WORDS = 600_000

_loaded: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary file; the folder is a parameter, the installed package the default."""
    if folder:
        return os.path.join(folder, name)
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):
    """The encoding, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        _loaded[path] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _loaded[path]


def with_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    pattern = F.lit(WORD_PATTERN)
    return docs.select(F.col(key), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), pattern, F.lit(0)).alias("words"))


_BLOCK = "block bigint, keys array<{kind}>, ends array<int>, codes binary, words array<string>"


def _blocks(words: DataFrame, key: str, kind: str) -> DataFrame:
    """One row a block: its keys, where each document's words end, the words as codes, and the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = batch.column(1).offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_WORDS, "right")) - 1)
                coded = batch.column(1).values.slice(starts[at], starts[end] - starts[at]).dictionary_encode()
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number]), one(batch.column(0).slice(at, end - at)), one(pa.array((starts[at + 1 : end + 1] - starts[at]).astype(np.int32))), pa.array([zlib.compress(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), 1)], pa.binary()), one(coded.dictionary)],
                    names=["block", "keys", "ends", "codes", "words"],
                )
                at, number = end, number + 1

    return words.mapInArrow(run, _BLOCK.format(kind=kind))


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            ids = [enc._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _joined(docs: DataFrame, key: str, text: str, path: str | None, what: str) -> DataFrame:
    """Blocks with what their words become: (block, keys, ends, codes, table), the table in the order of the codes."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = reliable(_blocks(with_words(docs, key, text), key, kind))
    used = blocks.select("block", F.posexplode("words").alias("code", "word"))
    table = used.select("word").distinct().mapInArrow(_encode_words(path or tokenizer_path()), "word string, ids array<int>")
    if what == "n_tokens":
        table = table.select("word", F.size("ids").alias("value"))
    else:
        table = table.select("word", F.col("ids").alias("value"))
    back = used.join(table, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "value"))).alias("t"))
    return blocks.drop("words").join(back.select("block", F.transform("t", lambda x: x["value"]).alias("table")), "block", "left")


def _parts(batch: pa.RecordBatch, row: int) -> tuple:
    """Keys, ends, codes and table of a block."""
    at = lambda c: batch.column(batch.schema.get_field_index(c))[row]
    return at("keys").values, at("ends").values, np.frombuffer(zlib.decompress(at("codes").as_py()), np.int32), at("table").values


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ends, codes, table = _parts(batch, r)
                ends = np.concatenate([[0], ends.to_numpy(zero_copy_only=False)])
                if table is None:  # no document of the block has a word
                    flat, tokens_ = np.zeros(0, np.int32), np.zeros(1, np.int64)
                else:
                    begin = table.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
                    each = np.diff(begin)[codes]
                    tokens_ = np.concatenate([[0], np.cumsum(each)])
                    flat = table.values.to_numpy(zero_copy_only=False)[np.repeat(begin[:-1][codes] - tokens_[:-1], each) + np.arange(tokens_[-1])]
                lists = pa.ListArray.from_arrays(pa.array(tokens_[ends].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    return _joined(docs, key, text, path, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens), without building the ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ends, codes, table = _parts(batch, r)
                ends = np.concatenate([[0], ends.to_numpy(zero_copy_only=False)])
                sizes = np.zeros(0, np.int64) if table is None else table.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                total = np.concatenate([[0], np.cumsum(sizes)])[ends]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(total))], names=[key, "n_tokens"])

    return _joined(docs, key, text, path, "n_tokens").mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token_id, piece) of the vocabulary, about fifty thousand rows whatever the corpus."""
    rows = [(i, bytearray(b)) for b, i in load_ranks(path or tokenizer_path()).items()]
    return spark.createDataFrame(rows, "token_id int, piece binary")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) from (key, ids) through a join of ids with pieces; key must be unique. No ids give the empty text."""
    ids = encoded.select(key, F.posexplode("ids").alias("at", "token_id"))
    pieces = F.broadcast(piece_table(encoded.sparkSession, path))
    joined = ids.join(pieces, "token_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8")
    return encoded.select(key).join(joined.select(key, text.alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
