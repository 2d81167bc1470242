"""Which files belong to a project: exclusion, catalogs, source directories, inferred targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED = (".build", ".git", "build", "Carthage", "DerivedData", "node_modules", "Pods", "vendor")
OPAQUE = (".xcloc", ".xcarchive", ".framework", ".bundle", ".app")


def glob_to_regex(pattern: str) -> str:
    """fnmatch's *, ? and [] over whole paths."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[at + 1 :]:
            end = pattern.index("]", at + 1)
            inner = pattern[at + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


def is_excluded(path: Column, names: tuple[str, ...] = EXCLUDED, globs: tuple[str, ...] = ()) -> Column:
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    for g in globs:
        out = out | path.rlike(glob_to_regex(g))
    return out | F.exists(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1)), lambda p: F.coalesce(p.rlike("(" + "|".join(re.escape(o) for o in OPAQUE) + ")$"), F.lit(False)))


def catalogs(files: DataFrame, **kw) -> DataFrame:
    return files.where(F.col("path").endswith(".xcstrings") & ~is_excluded(F.col("path"), **kw)).dropDuplicates(["path"])


def source_directories(files: DataFrame, extension: str = ".swift", **kw) -> DataFrame:
    """Top-level directories with a source file anywhere below. Paths are relative."""
    return files.where(F.col("path").endswith(extension) & F.col("path").contains("/") & ~is_excluded(F.col("path"), **kw)).select(F.substring_index("path", "/", 1).alias("directory")).distinct()


def infer_targets(files: DataFrame, **kw) -> DataFrame:
    """(target, catalog, ord): catalogs by the first part of their owner's path; the root's are target 'root'."""
    owned = catalogs(files, **kw).select(F.col("path").alias("catalog"), F.regexp_replace("path", r"(?:^|/)[^/]*\.lproj/[^/]*$|(?:^|/)[^/]*$", "").alias("owner"))
    target = F.when(F.col("owner") == "", "root").otherwise(F.substring_index("owner", "/", 1))
    from pyspark.sql import Window as W

    return owned.select(target.alias("target"), "catalog").withColumn("ord", F.row_number().over(W.partitionBy("target").orderBy("catalog")))
