"""Readers of saved clusterings.

A *result set* is one clustering: a text file, or an output folder of part files.  Below a
folder of results it is named by its path, ``runs/components`` or ``A1.txt``, so two outputs
never mix however their part files are called.  A line is ``id:member,member`` or a JSON
record with ``members`` and maybe ``community``; what is neither, and files that are no text
or hold no cluster, are listed with the reason and left out of the sets.  A file without a
byte is nothing to Spark and is not listed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources.positions import located

# Names of files that may hold cluster lines: without a suffix, .txt or .json, and compressed.
_TEXT = r"(^[^.]+|\.txt|\.json)(\.(gz|bz2|zst|snappy|lz4|deflate))?$"
NO_COLON, NO_MEMBERS, NO_TEXT, NO_CLUSTERS = "line without a colon", "record without members", "not a text file", "no cluster in the file"


class ResultSets(NamedTuple):
    """The clusterings below a folder.

    ``names`` has the sets with a cluster at least, ``clusters`` their clusters ``(name,
    cluster_id, members, at)``, ``rejected`` what was left out ``(name, file, reason,
    value)``; ``value`` is the line, or null where it is the whole file.
    """

    names: DataFrame
    clusters: DataFrame
    rejected: DataFrame


def _root(spark: SparkSession, path: str) -> str:
    """The path without scheme and host, as it leads the paths of all files below it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")


def _named(path: Column, root: str) -> tuple[Column, Column]:
    """Name of the result set of a file, and the file's path below ``root``."""
    plain = F.url_decode(F.replace(F.parse_url(path, F.lit("PATH")), F.lit("+"), F.lit("%2B")))
    own = F.lit(root.rsplit("/", 1)[-1])
    below = F.substr(plain, F.lit(len(root) + 2))
    folder = F.regexp_replace(below, r"(^|/)[^/]*$", "")
    name = F.when(F.regexp_extract(below, r"[^/]*$", 0).startswith("part-"), folder).otherwise(below)
    return F.when(name == "", own).otherwise(name), F.when(below == "", own).otherwise(below)


def result_sets(spark: SparkSession, root: str) -> ResultSets:
    """All clusterings in the file ``root``, or in the files and folders below it."""
    top = _root(spark, root)
    name, file = _named(F.col("at.path"), top)
    lines = located(spark.read.option("recursiveFileLookup", True).text(root)).select(
        name.alias("name"), file.alias("file"), "at", "value"
    ).where(F.regexp_extract("file", r"[^/]*$", 0).rlike(_TEXT))
    record = F.from_json("value", "community string, members array<string>")
    parts = F.split("value", ":", 2)
    told = F.when(F.ltrim("value").startswith("{"), F.struct(
        F.coalesce(record["community"], F.hex(F.xxhash64(record["members"]))).alias("cluster_id"), record["members"].alias("members"),
        F.when(record["members"].isNull(), NO_MEMBERS).alias("reason"),
    )).otherwise(F.struct(
        F.trim(parts[0]).alias("cluster_id"),
        F.when(F.size(parts) > 1, F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda m: F.trim(m))).alias("members"),
        F.when(F.size(parts) < 2, NO_COLON).alias("reason"),
    ))
    judged = lines.select("name", "file", "at", "value", told.alias("told")).select("name", "file", "at", "value", "told.*")
    clusters = judged.where("reason IS NULL").select("name", "cluster_id", "members", "at")
    # Only names and paths are read of the files themselves.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("_metadata.file_path").alias("path"))
    name, file = _named(F.col("path"), top)
    held = judged.groupBy("file").agg(F.count_if(F.col("reason").isNull()).alias("good"))
    bare = listed.select(name.alias("name"), file.alias("file")).join(held, "file", "left").where("coalesce(good, 0) = 0").select(
        "name", "file", F.when(F.regexp_extract("file", r"[^/]*$", 0).rlike(_TEXT), NO_CLUSTERS).otherwise(NO_TEXT).alias("reason"),
        F.lit(None).cast("string").alias("value"),
    )
    # An empty part file of an output folder that holds clusters is nothing to report.
    names = clusters.select("name").distinct()
    empty = bare.join(names, "name", "left_anti")
    bad = judged.where("reason IS NOT NULL").select("name", "file", "reason", "value")
    return ResultSets(names, clusters, bad.unionByName(empty))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Members of all clusters below ``path``: ``(name, at, cluster_id, position, activity)``.

    Blanks around members are dropped.
    """
    return result_sets(spark, path).clusters.select("name", "at", "cluster_id", F.posexplode("members").alias("position", "activity"))


def member_edges(clusters: DataFrame) -> DataFrame:
    """Consecutive members of each cluster: ``(name, src, dst, cluster_id, seq)``.

    Neighbours are paired inside the cluster's own array, without a shuffle; ``seq`` follows
    files and lines.
    """
    size = F.size("members")
    return (
        clusters.where(size > 1)
        .select(
            "name", "at", "cluster_id", "members",
            F.posexplode(F.slice("members", 2, size - 1)).alias("position", "dst"),
        )
        .select(
            "name",
            F.element_at("members", F.col("position") + 1).alias("src"),
            "dst",
            "cluster_id",
            F.struct("at", "position").alias("seq"),
        )
    )


def read_cluster_edges(spark: SparkSession, path: str) -> DataFrame:
    """``member_edges`` of all clusters below ``path``."""
    return member_edges(result_sets(spark, path).clusters)
