"""Directory graphs: paths from parent links, and rollups of trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The root's record number and the deepest path.
ROOT, DEEPEST = 5, 64
# Confidence of a directory entry by where it comes from; a hint does not replace an entry of 60 or more.
IN_USE, DELETED, HINT, NO_HINT_FROM = 85, 70, 55, 60


def directory_index(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One (node, parent, name) per node: the entry of the highest confidence, the first one on ties. entries also have confidence, seq.

    keys: columns that tell volumes (or scans) apart, as record numbers count anew in each.
    """
    best = F.max_by(F.struct("parent", "name"), F.struct("confidence", (-F.col("seq")).alias("seq"))).alias("x")
    return entries.groupBy(*(keys or []), "node").agg(best).select(*(keys or []), "node", "x.parent", "x.name")


def rebuild_paths(index: DataFrame, root: int = ROOT, deepest: int = DEEPEST, keys: list[str] | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, path) of (node, parent, name): links are doubled each round, so a depth of 64 takes six joins.

    A chain ends at the root, at 0 or at a parent that isn't in the index; a chain that runs in a circle is cut at deepest.
    keys: columns that tell volumes (or scans) apart; they come first in the result. settle writes a round's rows down (for
    example a checkpoint), which keeps plans small and ends the rounds once no chain is open.
    """
    keys = keys or []
    ends = F.col("parent").isin(root, 0) | (F.col("parent") == F.col("node"))
    hops = index.select(*keys, "node", F.when(~ends, F.col("parent")).alias("up"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth"))
    rounds = 0
    while 1 << rounds < deepest:
        rounds += 1
        upper = hops.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        joined = hops.join(upper, [*keys, "up"], "left")
        more = F.col("_path").isNotNull() & (F.col("depth") + F.col("_depth") <= deepest)
        hops = joined.select(*keys, "node", F.when(more, F.col("_up")).alias("up"), F.when(more, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"), F.when(more, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"))
        if settle:
            hops = settle(hops)
            if not hops.where("up is not null").limit(1).count():
                break
    return hops.select(*keys, "node", "path")


def tree_rollup(paths: DataFrame, column: str = "path", separator: str = "/") -> DataFrame:
    """(directory, files): how many paths lie below each directory at any depth."""
    parts = F.filter(F.split(F.col(column), separator), lambda x: x != "")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.lit(separator), F.array_join(F.slice(parts, 1, k), separator)))
    return paths.where(F.size(parts) > 0).select(F.explode(dirs).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def tree_children(paths: DataFrame, column: str = "path", separator: str = "/") -> DataFrame:
    """(directory, name, is_directory, files): the direct children of each directory."""
    parts = F.filter(F.split(F.col(column), separator), lambda x: x != "")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.concat(F.lit(separator), F.array_join(F.slice(parts, 1, k - 1), separator)).alias("directory"), F.element_at(parts, k).alias("name"), (k < F.size(parts)).alias("is_directory")))
    return paths.where(F.size(parts) > 0).select(F.explode(steps).alias("x")).select("x.*").groupBy("directory", "name", "is_directory").agg(F.count("*").alias("files"))
