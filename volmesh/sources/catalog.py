"""Catalogs of datasets in JSON, and tables of trees and blocks in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "name string, path string, type string, size struct<x:int,y:int,z:int>, limits array<double>, dataType string, availableTrees array<struct<kdTreeType:string,maxTreeDepth:int,leafCells:int,nodesPath:string>>, cornerValues array<struct<array:string,type:string,path:string>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """id and the fields of DATASET, a row for each key of the file's one object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "json")).select("id", F.from_json("json", DATASET).alias("d")).select("id", "d.*")


def find_tree(catalog: DataFrame, dataset: str, kind: str, depth: int, leaf_cells: int) -> DataFrame:
    """The prebuilt tree of a dataset that fits exactly, if any."""
    trees = catalog.where(F.col("id") == dataset).select("id", F.explode("availableTrees").alias("t")).select("id", "t.*")
    return trees.where((F.col("kdTreeType") == kind) & (F.col("maxTreeDepth") == depth) & (F.col("leafCells") == leaf_cells)).limit(1)


def corner_path(catalog: DataFrame, dataset: str, array: str, kind: str) -> DataFrame:
    """id, path of the corner values of a dataset's array that are of a kind, if there are any."""
    found = catalog.where(F.col("id") == dataset).select("id", F.explode("cornerValues").alias("c")).select("id", "c.*")
    return found.where((F.col("array") == array) & (F.col("type") == kind)).select("id", "path").limit(1)


def write_tree(path: str, **tables: DataFrame) -> None:
    """Each table (nodes, corner_values, node_ranges, limits, meta) in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_blocks(path: str, partitions: int, **tables: DataFrame) -> None:
    """Block tables in ranges of leaf_key, sorted, and beside each the least and largest leaf_key of its files, so that
    ``read_blocks`` opens the files of the wanted leaves alone."""
    for name, table in tables.items():
        table.repartitionByRange(partitions, "leaf_key").sortWithinPartitions("leaf_key").write.mode("overwrite").parquet(f"{path}/{name}")
        files = table.sparkSession.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("leaf_key").alias("lo"), F.max("leaf_key").alias("hi"))
        files.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}-files")


def read_blocks(spark: SparkSession, path: str, name: str, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the wanted leaves (leaf_key) from a table of ``write_blocks``; leaves that have none give no rows.

    The driver gets the bounds of the files, as many as were asked for in writing, and which of them hold a wanted leaf;
    the leaves themselves are matched by a join.
    """
    ids = wanted.select("leaf_key").distinct()
    bounds = spark.read.parquet(f"{path}/{name}-files").orderBy("lo", "file").collect()
    known = F.lit(None).cast("array<struct<i:int,lo:bigint,hi:bigint>>") if not bounds else F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f.lo).alias("lo"), F.lit(f.hi).alias("hi")) for i, f in enumerate(bounds)))
    holding = F.filter(known, lambda f: (f["lo"] <= F.col("leaf_key")) & (f["hi"] >= F.col("leaf_key")))
    hit = sorted(r.i for r in ids.select(F.explode(F.transform(holding, lambda f: f["i"])).alias("i")).distinct().collect())
    whole = spark.read.parquet(f"{path}/{name}")
    table = spark.read.schema(whole.schema).parquet(*(bounds[i].file for i in hit)) if hit else whole.limit(0)
    return (table if columns is None else table.select("leaf_key", *columns)).join(ids, "leaf_key", "left_semi")


def write_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
