"""Level-wise trees read what they are made from once."""

import pytest

from volmesh.operators import structured, tree


@pytest.mark.parametrize("strategy", [tree.VERT_MEDIAN, tree.SURFACE_AREA])
def test_cells_and_vertices_are_made_once(spark, strategy):
    size = (6, 5, 4)
    rows = {"cells": spark.sparkContext.accumulator(0), "points": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        def run(batches):
            for batch in batches:
                rows[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    bounds, points = structured.grid_cell_bounds(spark, size), structured.grid_points(spark, size)
    box = (0.0, 0.0, 0.0), tuple(float(s - 1) for s in size)
    nodes, leaves = tree.build_tree(counted(bounds, "cells"), box, strategy, 60, 4, counted(points, "points"))
    assert nodes.count() > 3 and leaves.count() >= 360
    assert rows["cells"].value == bounds.count()
    assert rows["points"].value == points.count()
