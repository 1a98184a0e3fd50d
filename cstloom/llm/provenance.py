"""Generated, minified, vendored and data files (problem 6).

A file's text is cut into tokens once.  Shingles of five tokens with masked
identifiers and literals, and shingles of five plain words, are clustered:

1. files with the same shingles are one entry, however many they are;
2. entries meet in the buckets of MinHash bands, first with the two entries of
   their bucket that come first by two hashes;
3. pairs are compared by their sketches, which bound from below how many shingles
   only one of both sets has: pairs out of reach of a Jaccard similarity of LEAST are
   left out, all others are verified on the whole sets, and the entries that links
   connect are a family;
4. then every pair of a bucket that no family connects yet is compared and verified
   in the same way, and its links join families.

So all entries that share a bucket and are similar are in one family, however many
the bucket holds.  What remains to chance is that a similar pair shares no bucket:
one in 9,000 pairs at LEAST, fewer above it, whatever the size of the tables.

A file without a like is a family of one.  Families are judged by what all their
files show:

* a masked family whose plain texts differ was written by one template; it is
  generated if its files repeat few shapes (REPEATS tokens a shingle) or enough of
  them carry marks of generation (header, name, folder);
* a family most of whose files are mainly literals is data, one most of whose files
  have long lines of short names is minified;
* a plain family across repositories is vendored; as marks of vendoring count the
  folder of third parties and a header that names a library with its version.

A family of one has to show more: a line shape repeated through most of the file,
or a header that says it.  ``marks=False`` judges by families and shapes alone.

Defined results: files whose extension isn't supported are none; a file without a
text is vendored if a folder of third parties holds it and nothing otherwise, as
names and folders of generated files only support what texts show; texts without
a token are alike to nothing; empty texts and empty tables give nothing; null
paths are skipped; rows delivered twice count once; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cstloom.llm.common import components, language_of
from cstloom.session import reliable

WORDS, LEAST = 5, 0.8
#: Minimum hashes of a set, bands, and the hashes that each band picks of them.
HASHES, BANDS, ROWS = 36, 30, 6
#: Share of odd characters from which a text is binary content, which shapes say nothing about.
BINARY = 0.05
#: Shares beyond which a file is repetitive, mainly literals; code characters a line and share of short names of minified files.
REPETITIVE, LITERAL, LONG_LINES, SHORT_NAMES = 0.6, 0.65, 50, 0.4
#: Characters of literals, and of code, that make a file of data, and a minified one.
LEAST_DATA, LEAST_MINIFIED = 120, 120
#: Tokens a masked shingle, and share of marked files, of a generated family; plain shingles of copies that speak without a mark.
REPEATS, MARKED, LEAST_COPY = 5.0, 0.3, 20

#: Folders of third parties and of generated files.
VENDOR_FOLDERS = {"third_party", "thirdparty", "3rdparty", "extern", "external", "externals", "vendor", "vendored", "Pods", "deps", "node_modules", "bower_components", "site-packages"}
GENERATED_FOLDERS = {"gen", "generated", "dist", "autogen"}
_GENERATED = re.compile(r"(?i)code generated by .*do not edit|auto-?generated file|@generated\b|<auto-?generated|this file (?:was|is|has been) (?:produced|(?:auto(?:matically)?[- ]?)?generated|created) by|edits will be lost|do not (?:modify|edit) by hand|changes are overwritten|output, version [\d.]+, schema rev|(?:auto-?|automatically )generated (?:by|from)|do not edit this file|regenerate with")
_VENDORED = re.compile(r"(?i)copied from upstream|@license\s+\S+\s+v?\d|\bpart of \S+, version \d|^\W*[\w.@/-]+ v\d+\.\d+(?:\.\d+)?\s*\W*$|\bv?\d+\.\d+(?:\.\d+)?\s+-\s+[\w. -]+ licensed|\(c\) the \S+ authors|, release \d+\.\d+")
_NAME_MARK = re.compile(r"(?:_pb2|\.pb|[._-](?:gen|autogen|generated|g|min|bundle|designer))\.\w+$")
_FUNCTION = re.compile(r"\b(?:def|function|func|fn|return|class|struct|impl)\b")
_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|\#(?!\s*(?:define|include|if|ifdef|ifndef|endif|else|undef|pragma)\b|\[)[^\n]*)|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(?P<i>[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<o>[^\s\w])""",
    re.S,
)
_KEYWORDS = set("if else for while return def class import from function const let var public private protected static new in of range func type struct package use fn pub impl self auto using foreach export extends this void int long double float string bool true false null None True False and or not break continue include define switch case default try catch throw prototype".split())

GEN, VENDOR, MINIFIED, DATA, REPEATED, WEAK = 1, 2, 4, 8, 16, 32


def path_marks(path: str) -> int:
    folders = set(path.split("/")[1:-1])
    return (VENDOR if folders & VENDOR_FOLDERS else 0) | (WEAK if folders & GENERATED_FOLDERS or _NAME_MARK.search(path) else 0)


def _header(text: str) -> list[str]:
    """The lines of the comment with which a file begins, to its end."""
    out, close = [], None
    for m in re.finditer(r"[^\n]+|\n(?=\n)", text.lstrip("\ufeff \t\r\n")):
        line = m[0].strip()
        if close is None:
            mark = re.match(r"//|#(?!include|define|\[|!)|/?\*|<!--", line) if line else None
            if line and not mark:
                break
            if mark and mark[0] in ("/*", "<!--"):
                close = "*/" if mark[0] == "/*" else "-->"
                line, begun = line[mark.end() :], mark[0]
            else:
                begun = ""
        else:
            begun = ""
        if close and close in line:
            close = None
        out.append(begun + line)
    return out


def header_marks(text: str, libraries: set[str]) -> int:
    marks = 0
    for line in _header(text):
        if _GENERATED.search(line):
            marks |= GEN
        elif _VENDORED.search(line) or (re.search(r"\b\d+\.\d+", line) and any(w.lower() in libraries for w in re.findall(r"[\w-]+", line))):
            marks |= VENDOR
    return marks


def _odd(text: str) -> int:
    """Characters that binary content shows in place of text: controls, unassigned ones, signs of Latin-1; letters, signs and punctuation of any script are none."""
    if text.isascii() and text.isprintable():
        return 0
    return sum(n for ch, n in Counter(text).items() if not (" " <= ch <= "~" or ch in "\n\t\r") and (ch == "\ufffd" or unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs") or ch <= "\xbf" and unicodedata.category(ch)[0] in "SN"))


def _hash_words(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = 1469598103934665603
            for b in w.encode():
                h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            known[w] = h
        out[k] = h
    return out


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Different hashes of all runs of WORDS codes."""
    if len(codes) < WORDS:
        codes = np.concatenate([codes, np.zeros(WORDS - len(codes), np.uint64)])
    n = len(codes) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)


_RNG = np.random.default_rng(61)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_PICKS = np.stack([_RNG.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])


def _words(size) -> np.ndarray:
    """64-bit words of a set's sketch: about a place a shingle, so that sets far from alike show it."""
    return np.maximum(4, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) // 64)


def _bands(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set's bands, and its sketch: whether an even or odd number of its shingles falls on each of 64 * _words(its size) places."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4_096):
        x = shingles[at : at + 4_096].view(np.uint32).astype(np.uint64)[None] * _MUL[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum(low, x.min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ low[_PICKS[:, r]]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    places = 64 * int(_words(len(shingles)))
    odd = np.bincount(shingles.view(np.uint32) & np.uint32(places - 1), minlength=places) & 1
    return key.view(np.int64), np.packbits(odd, bitorder="little").view(np.int16)


def examine(text: str, libraries: set[str], known: dict[str, int]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Marks of a text, the number of its tokens, and its masked and its plain shingles."""
    text = text.replace("\r\n", "\n").lstrip("﻿")
    marks = header_marks(text, libraries)
    masked: list[str] = []
    line_of: list[int] = []
    chars = {"c": 0, "s": 0, "i": 0, "n": 0, "o": 0}
    names = short = 0
    odd = _odd(text)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    starts: list[int] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        chars[kind] += m.end() - m.start()
        if kind == "c":
            continue
        if kind == "i":
            w = m[0]
            if w in _KEYWORDS:
                masked.append(w)
            else:
                names += 1
                short += len(w) <= 2
                masked.append("I")
        else:
            masked.append("S" if kind == "s" else "9" if kind == "n" else m[0])
        starts.append(m.start())
    code = chars["s"] + chars["i"] + chars["n"] + chars["o"]
    line_of = np.searchsorted(breaks, starts).tolist()
    shapes: dict[int, list[str]] = {}
    for line, w in zip(line_of, masked):
        shapes.setdefault(line, []).append(w)
    n_lines = max(1, len(shapes))
    counts = Counter("".join(s) if set(s) - {"9", ",", "-", "."} else "9" for s in shapes.values())
    if odd < BINARY * len(text) or not odd:
        literal = chars["s"] + chars["n"]
        if literal >= max(LEAST_DATA, LITERAL * code) and not _FUNCTION.search(re.sub(r"\bpublic class \w+", "", _TOKEN.sub(lambda m: " " if m.lastgroup in "cs" else m[0], text))):
            marks |= DATA
        elif len(shapes) >= 6 and counts.most_common(1)[0][1] / n_lines >= REPETITIVE:
            marks |= REPEATED
        elif code >= LEAST_MINIFIED and (code - literal) / n_lines >= LONG_LINES and names and (short / names >= SHORT_NAMES or code / n_lines >= 400):
            marks |= MINIFIED
    plain = re.findall(r"\w+", text)
    none = np.zeros(0, np.int32)
    return marks, len(masked), _shingles(_hash_words(masked, known)) if masked else none, _shingles(_hash_words(plain, known)) if plain else none


_SEEN = "file_id bigint, repo string, marks int, tokens int, kind int, bands array<bigint>, sketch array<smallint>, shingles array<int>"


def _examine_all(libraries: set[str], marked: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for file_id, repo, path, text in zip(pdf["file_id"], pdf["repo"], pdf["filepath"], pdf["text"]):
                own, tokens, sets = path_marks(path), 0, ()
                if text is not None and text.strip():
                    marks, tokens, *sets = examine(text, libraries, known)
                    own |= marks
                if not marked:
                    own &= ~(GEN | VENDOR | WEAK)
                if len(known) > 300_000:
                    known.clear()
                rows.append((file_id, repo, own, tokens, -1, None, None, None))
                rows += [(file_id, repo, own, tokens, kind, *_bands(s), s) for kind, s in enumerate(sets) if len(s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SEEN.split(", ")])

    return run


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= LEAST * (len(x) + len(y) - shared)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def _differences(flat: np.ndarray, at: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places on which the sketches of the sets i and j differ: never more than the shingles that only one of them has; the longer sketch is folded."""
    least, out = np.minimum(words[i], words[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least):
        own = np.flatnonzero(least == w)
        both = np.zeros((len(own), w), np.uint64)
        for side in (i[own], j[own]):
            for k in range(int(words[side].max()) // int(w)):
                wide = words[side] > k * w
                both[wide] ^= flat[at[side[wide]][:, None] + (k * w + np.arange(w))]
        out[own] = np.bitwise_count(both).sum(1)
    return out


def _in_reach(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles, apart or more of them in only one set, can have a similarity of LEAST."""
    return np.maximum(apart, abs(a - b)) * (1 + LEAST) <= (1 - LEAST) * (a + b) + 1e-6


def _flat(sketches: pa.ListArray) -> np.ndarray:
    return np.ascontiguousarray(sketches.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (kind, a, b) of rows with the sizes and sketches of both sets that are in reach of LEAST."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy().astype(np.int64) for c in (3, 4))
        words = _words(np.r_[a, b])
        flat = np.r_[_flat(batch.column(5)), _flat(batch.column(6))]
        i = np.flatnonzero(_in_reach(np.zeros(len(a), np.int64), a, b))
        near = i[_in_reach(_differences(flat, np.cumsum(words) - words, words, i, i + len(a)), a[i], b[i])]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near)) for c in range(3)], names=["kind", "a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by kind and band, cut only between buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, band = (batch.column(c).to_numpy() for c in (0, 1))
        ends = np.flatnonzero((kind[1:] != kind[:-1]) | (band[1:] != band[:-1])) + 1
        last = int(ends[-1]) if len(ends) else 0
        if last or held and [held[-1].column(c)[-1].as_py() for c in (0, 1)] != [kind[0], band[0]]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, band, ids) of the buckets with several entries."""
    for rows in _whole(batches):
        kind, band, ids = (rows.column(c).to_numpy() for c in range(3))
        new = np.r_[True, (kind[1:] != kind[:-1]) | (band[1:] != band[:-1])]
        size = np.diff(np.r_[np.flatnonzero(new), len(ids)])
        many = np.flatnonzero(new)[size > 1]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[size > 1])].astype(np.int32)), pa.array(ids[np.repeat(size > 1, size)]))
        yield pa.RecordBatch.from_arrays([pa.array(kind[many]), pa.array(band[many]), lists], names=["kind", "band", "ids"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that no family connects yet and whose sizes and sketches are in reach of LEAST.

    Entries of the bucket's largest family are only paired with the others.
    """
    most = lambda n: np.floor(n / LEAST + 1e-6).astype(np.int64)
    for rows in _whole(batches):
        kind, band, ids, family, size = (rows.column(c).to_numpy() for c in range(5))
        bucket = np.cumsum(np.r_[False, (kind[1:] != kind[:-1]) | (band[1:] != band[:-1])])
        order = np.lexsort((family, bucket))
        runs = np.flatnonzero(np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(family[order]) != 0)])
        length, of = np.diff(np.r_[runs, len(ids)]), bucket[order][runs]
        longest = np.lexsort((length, of))
        longest = longest[np.r_[of[longest][1:] != of[longest][:-1], True]]
        large = family == family[order][runs[longest]][bucket]
        order = np.lexsort((size, large, bucket))
        order = order[np.bincount(of)[bucket[order]] > 1]
        if not len(order):
            continue
        kind, ids, family, size, bucket, large = (x[order] for x in (kind, ids, family, size.astype(np.int64), bucket, large))
        words, flat = _words(size), _flat(rows.column(5).combine_chunks().take(pa.array(order)))
        at = np.cumsum(words) - words
        span = most(size.max()) + 1
        place = (2 * bucket + large) * span + size
        one = np.flatnonzero(~large)
        base = 2 * bucket[one] * span
        low = np.r_[one + 1, np.searchsorted(place, base + span + np.ceil(LEAST * size[one] - 1e-6).astype(np.int64))]
        high = np.r_[np.searchsorted(place, base + most(size[one]), "right"), np.searchsorted(place, base + span + most(size[one]), "right")]
        one, n = np.r_[one, one], np.maximum(high - low, 0)
        total = np.cumsum(n)
        step = max(1, 2**20 // int(words.max()))
        for begin in range(0, int(total[-1]), step):
            k = np.arange(begin, min(begin + step, int(total[-1])))
            r = np.searchsorted(total, k, "right")
            i, j = one[r], low[r] + k - (total - n)[r]
            other = family[i] != family[j]
            i, j = i[other], j[other]
            near = _in_reach(_differences(flat, at, words, i, j), size[i], size[j])
            i, j = i[near], j[near]
            first = ids[i] < ids[j]
            i, j = np.where(first, i, j), np.where(first, j, i)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind[i], ids[i], ids[j], family[i], family[j])], names=["kind", "a", "b", "fa", "fb"])


def families(seen: DataFrame) -> DataFrame:
    """(kind, file_id, family): the family of every file with shingles; seen holds file_id, kind, bands, sketch and shingles."""
    sets = seen.filter("kind >= 0")
    hashed = sets.select("kind", "file_id", F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit("second"), "shingles").alias("h2"))
    firsts = hashed.groupBy("kind", "h1", "h2").agg(F.min("file_id").alias("entry"))
    entries = reliable(hashed.join(firsts, ["kind", "h1", "h2"]).select("kind", "file_id", "entry"))
    own = sets.join(entries.filter("file_id = entry").select("kind", "file_id"), ["kind", "file_id"], "left_semi")
    sorted_by_bucket = lambda rows: rows.repartition("kind", "band").sortWithinPartitions("kind", "band")
    buckets = reliable(sorted_by_bucket(own.select("kind", F.explode("bands").alias("band"), "file_id")).mapInArrow(_crowded, "kind int, band bigint, ids array<bigint>"))

    def alike(pairs: DataFrame) -> DataFrame:
        compared = own.join(pairs.select("kind", F.explode(F.array("a", "b")).alias("file_id")).distinct(), ["kind", "file_id"], "left_semi")
        of = lambda x: compared.select("kind", F.col("file_id").alias(x), F.col("shingles").alias(f"s{x}"))
        return pairs.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"]).filter(_alike("sa", "sb")).drop("sa", "sb")

    head = lambda x: F.array_min(F.transform("ids", lambda i: F.struct(F.xxhash64(i, F.lit(x)).alias("h"), i.alias("id"))))["id"]
    pairs = buckets.select("kind", "ids", F.array(head(1), head(2)).alias("heads")).select("kind", "heads", F.explode("ids").alias("file_id")).select("kind", "file_id", F.explode("heads").alias("head")).filter("file_id <> head")
    pairs = pairs.select("kind", F.least("file_id", "head").alias("a"), F.greatest("file_id", "head").alias("b")).distinct()
    shown = sets.select("kind", "file_id", F.size("shingles").alias("size"), "sketch")
    of = lambda x: shown.select("kind", F.col("file_id").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    pairs = reliable(pairs.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"]).select("kind", "a", "b", "na", "nb", "ka", "kb").mapInArrow(_near, "kind int, a bigint, b bigint"))
    joined = components(alike(pairs), ["kind"]).select("kind", F.col("node").alias("entry"), "component")
    rows = buckets.select("kind", "band", F.explode("ids").alias("entry")).join(shown.withColumnRenamed("file_id", "entry").join(joined, ["kind", "entry"], "left"), ["kind", "entry"])
    rest = sorted_by_bucket(rows.select("kind", "band", "entry", F.coalesce("component", "entry").alias("family"), "size", "sketch")).mapInArrow(_apart, "kind int, a bigint, b bigint, fa bigint, fb bigint")
    rest = reliable(rest.distinct())
    family = entries.join(joined, ["kind", "entry"], "left").select("kind", "file_id", F.coalesce("component", "entry").alias("family"))
    if rest.isEmpty():
        return family
    merged = components(alike(rest).select("kind", F.col("fa").alias("a"), F.col("fb").alias("b")), ["kind"]).select("kind", F.col("node").alias("family"), F.col("component").alias("whole"))
    return family.join(merged, ["kind", "family"], "left").select("kind", "file_id", F.coalesce("whole", "family").alias("family"))


def judged_files(parse_results: DataFrame, chunks: DataFrame, library_index: DataFrame, marks: bool = True) -> DataFrame:
    """(file_id, generated, minified, vendored, data, family_files, family_repos, by_family): every file of a supported language and what it is.

    family_files and family_repos tell the masked family; by_family, whether a
    family of several files shows what the file is.
    """
    libraries = {r.library.lower() for r in library_index.select("library").distinct().collect() if r.library}
    supported = F.col("file_id").isNotNull() & language_of(F.col("filepath")).isNotNull()
    texts = chunks.filter((F.col("chunk_type") == "file") & supported).select("file_id", "repo", "filepath", "text").dropDuplicates(["file_id"])
    rest = parse_results.filter(supported).select("file_id", "repo", "filepath").dropDuplicates(["file_id"]).join(texts.select("file_id"), "file_id", "left_anti").withColumn("text", F.lit(None).cast("string"))
    seen = reliable(texts.unionByName(rest).mapInPandas(_examine_all(libraries, marks), _SEEN))
    has = lambda bit: F.col("marks").bitwiseAND(bit) > 0
    share = lambda c: F.avg(c.cast("double"))
    family = families(seen)
    both = family.groupBy("file_id").pivot("kind", [0, 1]).agg(F.first("family")).withColumnRenamed("0", "masked").withColumnRenamed("1", "plain")
    sizes = seen.filter("kind >= 0").groupBy("file_id").pivot("kind", [0, 1]).agg(F.first(F.size("shingles"))).withColumnRenamed("0", "n_masked").withColumnRenamed("1", "n_plain")
    files = reliable(seen.filter("kind < 0").select("file_id", "repo", "marks", "tokens").join(both, "file_id", "left").join(sizes, "file_id", "left"))
    many = files.groupBy("masked").agg(
        F.count("*").alias("family_files"), F.approx_count_distinct("repo").alias("family_repos"),
        (F.min("plain") < F.max("plain")).alias("differ"), (F.sum("tokens") / F.sum("n_masked")).alias("repeats"),
        share(has(GEN | WEAK)).alias("marked"), (share(has(DATA)) > 0.5).alias("blob"), (share(has(MINIFIED)) > 0.5).alias("mini"),
    ).filter("masked is not null and family_files > 1")
    copies = files.groupBy("plain").agg((F.min("repo") < F.max("repo")).alias("across"), F.avg("n_plain").alias("n"), F.max(has(VENDOR).cast("int")).alias("told")).filter("plain is not null and across")
    shown = files.join(many, "masked", "left").join(copies.select("plain", ((F.col("n") >= LEAST_COPY) | (F.col("told") > 0)).alias("copied")), "plain", "left")
    also = lambda c: F.coalesce(c if not isinstance(c, str) else F.col(c), F.lit(False))
    data, mini = has(DATA) | also("blob"), has(MINIFIED) | also("mini")
    template = also(F.col("differ") & ((F.col("repeats") >= REPEATS) | (F.col("marked") >= MARKED))) & ~data & ~mini
    return shown.select(
        "file_id", (has(GEN | REPEATED) | template).alias("generated"), mini.alias("minified"), (has(VENDOR) | also("copied")).alias("vendored"), data.alias("data"),
        F.coalesce("family_files", F.lit(1)).alias("family_files"), F.coalesce("family_repos", F.lit(1)).alias("family_repos"), (template | also("blob") | also("mini") | also("copied")).alias("by_family"),
    )


def not_hand_written(parse_results: DataFrame, chunks: DataFrame, library_index: DataFrame) -> DataFrame:
    """(file_id) of generated, minified, vendored and data files."""
    return judged_files(parse_results, chunks, library_index).filter("generated or minified or vendored or data").select("file_id")
