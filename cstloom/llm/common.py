"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cstloom.session import reliable

#: The node types of functions and methods.
FUNCTION_TYPES = ("function_definition", "function_declaration", "function_item", "method_declaration", "method_definition")

#: The language of each extension (.c and .h belong to C, .mjs and .jsx to JavaScript).
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp",
}


def language_of(path: Column) -> Column:
    """The language of a path's extension, null if it isn't supported."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def functions_of(chunks: DataFrame) -> DataFrame:
    """The rows of functions and methods; rows delivered twice are still there twice."""
    return chunks.filter(F.col("chunk_type").isin(*FUNCTION_TYPES) & F.col("chunk_no").isNotNull())


def components(links: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(*within, node, component): the smallest node that links (a, b) connect with each linked node.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so paths shrink by half or more.  Labels stay in tables
    and minima are combined before they are shuffled.
    """
    keys = list(within or [])
    ways = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = reliable(ways.filter("a <> b").distinct())
    labels = reliable(edges.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(*keys, F.col("node").alias("component"), F.col("component").alias("further"))
        moved = reliable(lower.join(jump, [*keys, "component"], "left").select(*keys, "node", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = moved.drop("was")
        if moved.filter("component < was").isEmpty():
            return labels
