"""Scoring documents for abusive, hateful and sexual language (problem 10).

A convolutional text classifier in numpy: words are normalised (case, accents,
look-alike digits and signs, stretched and spaced-out letters), hashed, and
embedded; filters of several widths slide over the whole text, the greatest
answer of each filter is kept, and a logistic layer turns these into a score for
each category.  It is trained on documents with human labels: the judgements of
a document are averaged over annotators (repeated rows count once), so that
annotators who err weigh less.  The bound of the sample is SAMPLE documents, in
the order of a hash of their id.  Words that fewer than SEEN sampled documents
use, and that no listed term holds, share one embedding.  Thresholds are calibrated by language on the documents
held out from training.

Defined results: null, empty and blank texts score 0; null labels are ignored;
documents with repeated rows are judged once; without any labelled document, or
with labels of one kind only, the word list alone decides; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
SAMPLE, SEEN = 12_000, 3
#: One document in so many is held out for the thresholds; a language needs so many positive ones for a threshold of its own.
HELD_OUT, LEAST_POSITIVE = 5, 10
#: Embedding size, filters of each width, widths (1 and up), steps, documents a step, words of a block.
DIM, FILTERS, WIDTHS, STEPS, BATCH, BLOCK = 24, 24, (1, 2, 3, 4), 1_200, 48, 12
#: Words of a stretch that is scored at once, characters of a batch of texts, and pieces remembered at once; they only bound memory.
STRETCH, BATCH_CHARS, REMEMBERED = 6_000, 2_000_000, 400_000
#: Signs that stand for letters inside words.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "µ": "u", "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "і": "i", "у": "y", "х": "x"})
_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!|€*'’]+[^\W\d_]+)*|[0-9@$]+[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)*|[.!?\n>]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_JOINED = re.compile(r"(?<=[^\W\d_])(?:[​-‏­⁠﻿]|[.\-_*·](?=[^\W\d_][.\-_*·]))(?=[^\W\d_])")


@lru_cache(1 << 17)
def normal(word: str) -> str:
    """The form under which a word is looked up."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    if not w.isalpha():
        w = w.translate(LOOK_ALIKE).replace("'", "").replace("’", "")
    if "*" in w:
        return "*"  # a word with letters blotted out
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(1 << 18)
def word_hash(word: str) -> int:
    return zlib.crc32(normal(word).encode())


def words_of(text: str) -> list[int]:
    """Hashes of the words of a text; sentence ends and quote marks count as words."""
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    if not text.isascii():
        text = re.sub("[​-‏­⁠﻿]", "", text)
    return [word_hash(w) for w in _WORD.findall(text)]


class Vocabulary:
    """Row numbers of known word hashes; row 0 is any other word."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def rows(self, words: list[int]) -> np.ndarray:
        w = np.array(words, np.int64)
        if not len(self.hashes) or not len(w):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w, at + 1, 0)


_LONE_HEAD, _LONE_TAIL = re.compile(r"[^\W\d_](?![^\W_])"), re.compile(r"(?<![^\W_])[^\W\d_]\Z")
_LONE_PAIR = re.compile(r"(?<![^\W_])[^\W\d_][.\-_*][^\W\d_](?![^\W_])")
_BREAK = "\0"


class Reader(dict):
    """Rows of the words of texts, as words_of and Vocabulary.rows give them.

    Texts are cut at white space, and a piece is read once and remembered.  Only
    letters spaced out over several pieces need the whole text, which is then
    read as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.row_of = {h: k + 1 for k, h in enumerate(vocabulary.hashes.tolist())}
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.flat, self.starts, self.sizes, self.lone = array("q"), array("q"), array("q"), bytearray()

    def __missing__(self, piece: str) -> int:
        row, me, lone = self.row_of, len(self.starts), 0
        if piece.isalpha():
            rows = [row.get(word_hash(piece), 0)]
            lone = 3 * (len(piece) == 1)
        else:
            rows = [row.get(h, 0) for h in words_of("\n" if piece == _BREAK else piece)]
            lone = bool(_LONE_HEAD.match(piece)) + 2 * bool(_LONE_TAIL.search(piece[-2:])) + 4 * bool(_LONE_PAIR.search(piece))
        self.starts.append(len(self.flat))
        self.sizes.append(len(rows))
        self.lone.append(lone)
        self.flat.extend(rows)
        self[piece] = me
        return me

    def read(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self) > REMEMBERED or len(self.flat) > 20 * REMEMBERED:
            self._forget()
        pieces, counts = [], []
        for text in texts:
            own = text.replace(_BREAK, " ").replace("\n", f" {_BREAK} ").split()
            pieces += own
            counts.append(len(own))
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        lone, sizes, starts = (np.array(x)[at] for x in (np.frombuffer(self.lone, np.uint8), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.starts, np.int64)))
        ends = np.cumsum(counts)
        next_to = np.zeros(len(at) + 1, bool)  # a lone letter ends a piece and one begins the next
        next_to[:-2] = (lone[:-1] & 2 > 0) & (lone[1:] & 1 > 0)
        next_to[ends - 1] = False
        pair = lone & 4 > 0
        spaced = next_to[:-1] & (next_to[1:] | pair | np.r_[pair[1:], False]) if len(at) else next_to[:-1]
        before = np.cumsum(sizes) - sizes
        flat = np.array(np.frombuffer(self.flat, np.int64))[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        cut = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        whole = set(np.searchsorted(ends, np.flatnonzero(spaced), "right").tolist())
        return [self.vocabulary.rows(words_of(text)) if i in whole else flat[cut[i] : cut[i + 1]] for i, text in enumerate(texts)]


class TextCnn:
    """Embedding, filters of several widths, maximum over a window, logistic layer, maximum over the windows.

    Windows of two blocks of BLOCK words slide by one block, so that answers from
    far apart in a text never add up.  The filters stand in the order of their
    widths; ``W{j}`` holds what the j-th word contributes to those wide enough.
    """

    def __init__(self, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        one = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        scale = np.repeat([1 / np.sqrt(w * DIM) for w in WIDTHS], FILTERS).astype(np.float32)
        self.p = {"E": 0.3 * one(rows, DIM), "V": 0.1 * one(len(WIDTHS) * FILTERS, len(CATEGORIES)), "c": np.full(len(CATEGORIES), -2.5, np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        self.p["E"][0] = 0
        for j in range(len(WIDTHS)):
            self.p[f"W{j}"] = one(DIM, (len(WIDTHS) - j) * FILTERS) * scale[j * FILTERS :]

    def tables(self, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """For each place in a filter, what a word adds to the answers of the filters that reach so far."""
        e = self.p["E"] if rows is None else self.p["E"][rows]
        return [e @ self.p[f"W{j}"] for j in range(len(WIDTHS))]

    @staticmethod
    def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All documents behind one another, padded to whole blocks and one more, and the blocks of each."""
        size = np.array([len(d) for d in docs])
        blocks = -(-(size + 1) // BLOCK) + 1
        starts = np.cumsum(blocks) - blocks
        ids = np.zeros(int(blocks.sum()) * BLOCK + len(WIDTHS), np.int64)
        ids[np.repeat(starts * BLOCK - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.concatenate(docs)
        return ids, blocks

    def answers(self, ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """(blocks, BLOCK, filters): every filter's answer at every word but the last few."""
        n = len(ids) - len(WIDTHS)
        h = tables[0][ids[:n]]
        for j in range(1, len(WIDTHS)):
            h[:, j * FILTERS :] += tables[j][ids[j : j + n]]
        return h.reshape(-1, BLOCK, h.shape[1])

    def logits(self, docs: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        ids, blocks = self._joined(docs)
        step = STRETCH // BLOCK * BLOCK
        best = np.concatenate([self.answers(ids[at : min(at + step, len(ids) - len(WIDTHS)) + len(WIDTHS)], tables).max(1) for at in range(0, len(ids) - len(WIDTHS), step)]) + self.p["b"]
        z = np.maximum(0, np.maximum(best[:-1], best[1:])) @ self.p["V"] + self.p["c"]
        z = np.vstack([z, np.full((1, z.shape[1]), -99, np.float32)])
        ends = np.cumsum(blocks)
        z[ends - 1] = -99  # the window that would reach into the next document
        return np.maximum.reduceat(z, ends - blocks)

    def scores(self, docs: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(docs, tables), -30, 30))) if docs else np.zeros((0, len(CATEGORIES)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 4, steps: int = STEPS) -> TextCnn:
        """Adam on BATCH documents a step; only the embeddings of words whose answers were kept move."""
        rng = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        size, order = len(CATEGORIES), np.zeros(0, np.int64)
        y, weight = y.astype(np.float32), weight.astype(np.float32)
        for t in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(docs))])
            pick, order = order[:BATCH], order[BATCH:]
            ids, blocks = self._joined([docs[i] for i in pick])
            ids[rng.random(len(ids)) < 0.1] = 0  # words are left out now and then, so that no single one carries a sentence
            known, local = np.unique(ids, return_inverse=True)
            h = self.answers(local, self.tables(known))
            best = h.max(1) + self.p["b"]
            first = best[:-1] >= best[1:]
            drop = ((rng.random(best.shape[1]) > 0.2) / 0.8).astype(np.float32)
            r = np.maximum(0, np.where(first, best[:-1], best[1:])) * drop
            z = r @ self.p["V"] + self.p["c"]
            ends = np.cumsum(blocks)
            z[ends[:-1] - 1] = -99
            chosen = np.array([a + z[a : min(b, len(z))].argmax(0) for a, b in zip(ends - blocks, ends)])
            prob = 1 / (1 + np.exp(-np.clip(np.take_along_axis(z, chosen, 0), -30, 30)))
            dz = (prob - y[pick]) * weight[pick, None] / len(pick)
            rows, back = np.unique(chosen.ravel(), return_inverse=True)
            dw = np.zeros((len(rows), size), np.float32)
            np.add.at(dw, (back.ravel(), np.tile(np.arange(size), len(pick))), dz.ravel())
            rr = r[rows]
            g = {"V": rr.T @ dw + 1e-4 * self.p["V"], "c": dw.sum(0)}
            da = (dw @ self.p["V"].T) * (rr > 0) * drop
            g["b"] = da.sum(0)
            row, filter_ = np.nonzero(da)
            d, block = da[row, filter_], rows[row] + ~first[rows[row], filter_]
            spot = block * BLOCK + h[block, :, filter_].argmax(1)
            moved, by = [], []
            for j in range(len(WIDTHS)):
                far = filter_ >= j * FILTERS
                f, dj, words = filter_[far] - j * FILTERS, d[far], ids[spot[far] + j]
                w = self.p[f"W{j}"]
                turn = np.argsort(f, kind="stable")
                edge = np.searchsorted(f[turn], np.arange(w.shape[1]))
                gw = np.add.reduceat(np.vstack([self.p["E"][words[turn]] * dj[turn, None], np.zeros((1, DIM), np.float32)]), edge, axis=0)
                gw[np.diff(np.r_[edge, len(f)]) == 0] = 0
                g[f"W{j}"] = gw.T
                moved.append(words)
                by.append(dj[:, None] * w.T[f])
            words, change = np.concatenate(moved), np.concatenate(by)
            change, words = change[words > 0], words[words > 0]  # other words say nothing
            rate = 0.006 * (1 - 0.8 * t / steps)
            low, high = 1 - 0.9**t, 1 - 0.999**t
            if len(words):
                turn = np.argsort(words, kind="stable")
                own, new = np.unique(words[turn], return_index=True)
                ge = np.add.reduceat(change[turn], new, axis=0) + 2e-5 * self.p["E"][own]
                m["E"][own] += 0.1 * (ge - m["E"][own])
                v["E"][own] += 0.001 * (ge * ge - v["E"][own])
                self.p["E"][own] -= rate * (m["E"][own] / low) / (np.sqrt(v["E"][own] / high) + 1e-8)
            for key, x in g.items():
                m[key] += 0.1 * (x - m[key])
                v[key] += 0.001 * (x * x - v[key])
                self.p[key] -= (rate * (m[key] / low) / (np.sqrt(v[key] / high) + 1e-8)).astype(np.float32)
        return self


def labelled_sample(documents: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """doc_id, text, lang and the mean judgement of each category, of at most SAMPLE documents."""
    votes = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "annotator", "label").distinct()
    shares = votes.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.avg((F.col("label") == c).cast("double")).alias(c) for c in CATEGORIES])
    few = shares.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return documents.filter(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).toPandas()


class Judge:
    """A trained classifier with its vocabulary and thresholds by language."""

    def __init__(self, vocabulary: Vocabulary, cnn: TextCnn, thresholds: dict[str, float]):
        self.vocabulary, self.thresholds = vocabulary, thresholds
        self.tables = cnn.tables()
        self.cnn = cnn
        self.cnn.p["E"] = np.zeros((1, DIM), np.float32)  # the tables hold all that scoring needs
        self.reader: Reader | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "reader": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text and one column for each category; batches are cut by length."""
        self.reader = self.reader if self.reader is not None else Reader(self.vocabulary)
        out = np.zeros((len(texts), len(CATEGORIES)))
        told = [(i, t) for i, t in enumerate(texts) if t and t.strip()]
        at = 0
        while at < len(told):
            end, size = at, 0
            while end < len(told) and (end == at or size < BATCH_CHARS):
                size += len(told[end][1])
                end += 1
            out[[i for i, _ in told[at:end]]] = self.cnn.scores(self.reader.read([t for _, t in told[at:end]]), self.tables)
            at = end
        return out

    def flags(self, score: np.ndarray, langs: list[str | None]) -> np.ndarray:
        return score.max(1) >= np.array([self.thresholds.get(x, self.thresholds[""]) for x in langs]) if len(score) else np.zeros(0, bool)


class ListJudge:
    """The word list alone: a text with the words of a listed term one after another has score 1 in its category."""

    def __init__(self, terms: list[tuple[list[int], str]]):
        self.terms: dict[int, list[tuple[list[int], int]]] = {}
        for words, category in terms:
            if words:
                self.terms.setdefault(words[0], []).append((words, CATEGORIES.index(category)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(CATEGORIES)))
        for i, text in enumerate(texts):
            words = words_of(text or "")
            for at, w in enumerate(words):
                for term, k in self.terms.get(w, ()):
                    if words[at : at + len(term)] == term:
                        out[i, k] = 1.0
        return out

    def flags(self, score: np.ndarray, langs: list[str | None]) -> np.ndarray:
        return score.max(1) > 0.5 if len(score) else np.zeros(0, bool)


def _best_threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """Where the F1 measure is greatest; midway to the next score."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + truth.sum())
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def train(sample: pd.DataFrame, terms: pd.DataFrame | None = None) -> Judge | ListJudge:
    """Train on labelled documents; two folds judge each other first, and labels that both the other documents and the text speak against lose weight."""
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    words = [words_of(t) for t in sample["text"]]
    seen = Counter(w for d in words for w in set(d))
    told = [(words_of(t), c) for t, c in zip(terms["term"], terms["category"]) if c in CATEGORIES and t] if terms is not None else []
    known = {w for w, n in seen.items() if n >= SEEN}.union(*(w for w, _ in told))
    vocabulary = Vocabulary(np.array(sorted(known), np.int64))
    docs = [vocabulary.rows(w) for w in words]
    y = sample[list(CATEGORIES)].to_numpy(float).reshape(-1, len(CATEGORIES))
    listed = [(vocabulary.rows(w), c) for w, c in told]  # each listed term is a short document of its own, of little weight
    extra = [d for d, _ in listed if d.any()]
    extra_y = np.array([[float(c == x) for x in CATEGORIES] for d, c in listed if d.any()]).reshape(-1, len(CATEGORIES))
    rows = len(vocabulary.hashes) + 1

    def fitted(pick: np.ndarray, weight: np.ndarray, seed: int, steps: int) -> TextCnn:
        all_y = np.vstack([y[pick], extra_y])
        return TextCnn(rows, seed).fit([docs[i] for i in pick] + extra, all_y, np.concatenate([weight[pick], np.full(len(extra), 0.2)]), seed, steps)

    n = len(docs)
    weight = np.ones(n)
    if not n or not (y.max(1) > 0.5).any() or (y.max(1) > 0.5).all():
        return ListJudge(told)
    if n < 20:
        return Judge(vocabulary, fitted(np.arange(n), weight, 3, STEPS), {"": 0.5})
    fold = np.arange(n) % 2
    held = np.zeros((n, len(CATEGORIES)))
    for f in (0, 1):
        cnn = fitted(np.flatnonzero(fold != f), weight, 10 + f, STEPS // 2)
        held[fold == f] = cnn.scores([docs[i] for i in np.flatnonzero(fold == f)], cnn.tables())
    weight = np.clip(1.5 * (1 - np.abs(held.max(1) - y.max(1))), 0.05, 1.0)
    out = np.arange(n) % HELD_OUT == 0
    cnn = fitted(np.flatnonzero(~out), weight, 3, STEPS)
    top = np.zeros(n)
    top[out] = cnn.scores([docs[i] for i in np.flatnonzero(out)], cnn.tables()).max(1)
    truth = y.max(1) > 0.5
    use = np.flatnonzero(out & (weight > 0.3))  # labels that the folds speak against don't set thresholds
    thresholds = {"": _best_threshold(top[use], truth[use]) if truth[use].any() else 0.5}
    langs = sample["lang"].fillna("").to_numpy()
    for lang in sorted(set(langs[use]) - {""}):
        own = use[langs[use] == lang]
        if truth[own].sum() >= LEAST_POSITIVE:
            thresholds[lang] = _best_threshold(top[own], truth[own])
    return Judge(vocabulary, cnn, thresholds)


def fit(documents: DataFrame, labels: DataFrame, terms: DataFrame | None = None) -> Judge | ListJudge:
    """A judge trained on the sample of labelled documents, and the listed terms."""
    return train(labelled_sample(documents, labels), terms.select("term", "category").distinct().toPandas() if terms is not None else None)


def scored(documents: DataFrame, labels: DataFrame, terms: DataFrame | None = None, fitted: Judge | ListJudge | None = None) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual, flagged) of every document, by a fitted judge if one is given."""
    judge = documents.sparkSession.sparkContext.broadcast(fitted if fitted is not None else fit(documents, labels, terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = judge.value.score(pdf["text"].tolist())
            flagged = judge.value.flags(s, pdf["lang"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], **{c: s[:, k].round(6) for k, c in enumerate(CATEGORIES)}, "flagged": flagged})

    return documents.select("doc_id", "source", "lang", "text").mapInPandas(run, "doc_id bigint, source string, abusive double, hateful double, sexual double, flagged boolean")


def rates(scores: DataFrame) -> DataFrame:
    """(source, documents, flagged_documents, flagged_share) by source; null sources count as one."""
    g = scores.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("int")).alias("flagged_documents"))
    return g.withColumn("flagged_share", F.round(F.col("flagged_documents") / F.col("documents"), 6))
