"""Tables over the sizes that are broadcast are used whole."""

from pyspark.sql import functions as F

from volmesh.operators import lod, nodevalues, reports


def test_views_segments_and_names_beyond_a_broadcast(spark):
    n = 10_050
    unit = F.array(*(F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)))
    views = spark.range(n).select(F.col("id").alias("view_id"), *(F.lit(-3.0).alias(f"e{a}") for a in "xyz"), unit.alias("mat"), F.lit("count").alias("iso_name"), F.lit(1.0).alias("iso"))
    nodes = spark.range(1).select(F.lit(1).cast("long").alias("node_key"), F.lit(True).alias("is_leaf"), *(F.lit(float(i)).alias(f"{a}{i}") for a in "xyz" for i in range(2)))
    ranges = spark.createDataFrame([(1, "count", 0.0, 2.0)], "node_key long, name string, lo double, hi double")
    assert lod.scores(views, nodes, ranges, ranges.drop("node_key")).select("view_id").distinct().count() == n
    ids = F.col("id").cast("double")
    segments = spark.range(n).select(ids.alias("t0"), (ids + 1).alias("t1"), *(F.lit(1.0).alias(c) for c in ("r0", "r1", "az0", "az1", "el0", "el1")))
    times = spark.range(0, n, 150).select((F.col("id") + 0.5).alias("t"))
    assert reports.camera_at(times, segments).count() == times.count()
    fields = spark.range(1030).select(F.lit(0).cast("long").alias("point_id"), F.concat(F.lit("f"), "id").alias("name"), F.lit(1.0).alias("value"))
    cells = spark.createDataFrame([(0, 0, 0, 0, 0)], "cell_id long, v0 long, v1 long, v2 long, v3 long")
    leaf_cells = spark.createDataFrame([(1, 0)], "leaf_key long, cell_id long")
    assert nodevalues.leaf_ranges(leaf_cells, cells, fields, nodes).count() == 1030
