"""Chunk metadata: flattening for a collection, the text that is embedded, and back.

Null values and blank strings are dropped; lists lose blank items and are
joined; an empty list is dropped, a list of blanks becomes the empty string.  An
item that holds the joint itself can't be told apart from two items afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINT = " | "


def joined(items: str | Column) -> Column:
    c = F.col(items) if isinstance(items, str) else items
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(c) > 0, F.array_join(kept, JOINT))


def split_again(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, r" [|] "), lambda x: F.trim(x)), lambda x: x != "")


def flattened(strings: dict[str, Column], lists: dict[str, Column], numbers: dict[str, Column] | None = None) -> Column:
    """A map of strings without the keys that have nothing to say."""
    pairs: list[Column] = []
    for name, c in strings.items():
        t = F.trim(c)
        pairs += [F.lit(name), F.when(t != "", t)]
    for name, c in lists.items():
        pairs += [F.lit(name), joined(c)]
    for name, c in (numbers or {}).items():
        pairs += [F.lit(name), c.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def enhanced_text(summary: Column, kind: Column, language: Column, name: Column, parent: Column, keywords: Column, dependencies: Column, text: Column) -> Column:
    """The text that is embedded: labelled lines, those without content left out, and the code."""
    some = lambda c: c.isNotNull() & (c != "")
    listed = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(F.array_sort(c), 1, n), ", ")))
    return F.concat_ws(
        "\n",
        F.when(some(summary), F.concat(F.lit("Summary: "), summary)), F.concat(F.lit("Type: "), F.coalesce(kind, F.lit("unknown"))), F.concat(F.lit("Language: "), F.coalesce(language, F.lit("unknown"))), F.concat(F.lit("Name: "), F.coalesce(name, F.lit("unnamed"))),
        F.when(some(parent), F.concat(F.lit("Parent: "), parent)), listed("Keywords: ", keywords, 10), listed("Uses: ", dependencies, 5), F.concat(F.lit("Code:\n"), F.coalesce(text, F.lit(""))),
    )


def extract_code(document: str | Column) -> Column:
    c = F.col(document) if isinstance(document, str) else document
    at = F.locate("Code:\n", c)
    return F.when(at > 0, F.substring(c, at + 6, F.length(c))).otherwise(c)


def collection_name(model: str) -> str:
    return "codebase_" + model.replace("-", "_").replace(".", "_")
