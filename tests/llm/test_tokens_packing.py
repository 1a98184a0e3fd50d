import numpy as np
import pytest

from cstloom.llm import packing, tokens

TEXTS = [None, "", " ", "a", "Hello world, it's  2024!\n\n\tx", "<|endoftext|> é ü 中文 🙂\r\n", "x" * 60_000, "\x00\x1c\x85   　 a", "don't DON'T 'll", "Hello world, it's  2024!\n\n\tx"]


def test_ids_and_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, words string")
    ids = tokens.encode(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r.doc_id: r.text for r in tokens.decode(ids).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


def check(rows, sizes, capacity):
    fill, parts = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.length
        parts.setdefault(r.doc_id, []).append((r.first_token, r.length))
    assert max(fill.values()) <= capacity
    for doc, pieces in parts.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) == sizes[doc]
        assert len(pieces) == 1 or sizes[doc] > capacity
    assert set(parts) == {d for d, s in sizes.items() if s and s > 0}
    return len(fill)


def test_packing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = {i: int(x) for i, x in enumerate(rng.integers(1, 120, 900))} | {2000: 0, 2001: None, 2002: -3, 2003: 1000, 2004: 200, 2005: 100}
    df = spark.createDataFrame([(d, s, 1) for d, s in sizes.items()], "doc_id bigint, n_tokens bigint, container int")
    least = -(-sum(s for s in sizes.values() if s and s > 0) // 100)
    for shard, group in ((20_000, 20_000), (100, 20_000), (100, 60)):
        monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
        monkeypatch.setattr(packing, "GROUP_ITEMS", group)
        rows = packing.pack(df, [("w", 100), ("none", 0)]).collect()
        assert check(rows, sizes, 100) <= 1.1 * least
    assert packing.pack(df.limit(0), [("w", 100)]).count() == 0


def test_sum_of_squares_rule():
    assert packing.sum_of_squares(np.array([6, 4, 6, 4, 10]), 10).tolist() == [0, 0, 1, 1, 2]
    assert packing.sum_of_squares(np.array([], int), 10).tolist() == []
