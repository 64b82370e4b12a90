"""Versions of files, kept when a command rewrites them: listed, narrowed to a target, and restored as of a batch.

Versions are rows (path, hash, batch, at) that are only ever added; contents (hash, content) are kept once for all files and
versions that share them. The state of a file as of a batch is its last version up to it: one aggregation over rows without texts,
and a join with the contents that it names.

Defined results: of several versions of a path in a batch the last by (at, hash) counts; a null batch is before all others; a path that has
no version up to the batch is not restored; a null content is kept and restored as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the content of a file that has none.
NOTHING = "none"


def content_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(NOTHING))


def taken(files: DataFrame, batch: Column, at: Column) -> DataFrame:
    """The versions (path, hash, batch, at) that a batch adds for files (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("hash"), batch.cast("long").alias("batch"), at.alias("at"))


def new_contents(files: DataFrame, contents: DataFrame) -> DataFrame:
    """The contents (hash, content) that files add to those that are there."""
    own = files.select(content_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
    return own.join(contents.select("hash"), "hash", "left_anti")


def under(path: Column, target: str | None) -> Column:
    """Whether a path is the target or lies in it; slashes at its end do not matter."""
    if target is None or not target.rstrip("/"):
        return F.lit(True)
    wanted = target.replace("\\", "/").rstrip("/")
    return (path == wanted) | path.startswith(f"{wanted}/")


def listed(versions: DataFrame, target: str | None = None, batch: int | None = None) -> DataFrame:
    """(path, hash, batch, at): what restored() would bring back."""
    rows = versions.where(under(F.col("path"), target))
    if batch is not None:
        rows = rows.where(F.col("batch").isNull() | (F.col("batch") <= batch))
    order = F.struct(F.coalesce("batch", F.lit(-(2**63))), "at", "hash")
    return rows.groupBy("path").agg(F.max_by(F.struct("hash", "batch", "at"), order).alias("v")).select("path", "v.*")


def restored(versions: DataFrame, contents: DataFrame, target: str | None = None, batch: int | None = None) -> DataFrame:
    """(path, content, batch) as of a batch, or as of the last one."""
    return listed(versions, target, batch).join(contents, "hash", "left").select("path", "content", "batch")


def changed_since(versions: DataFrame, contents: DataFrame, files: DataFrame, target: str | None = None, batch: int | None = None) -> DataFrame:
    """(path, content) of those that differ from the files that are there: what a restore has to write."""
    now = files.select("path", content_hash(F.col("content")).alias("now"))
    back = listed(versions, target, batch).join(now, "path", "left").where(~F.col("hash").eqNullSafe(F.col("now")))
    return back.join(contents, "hash", "left").select("path", "content")
