"""A whole ingest from options: downsample, make unstructured, build a tree, split into blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from volmesh.operators import blocks, mesh, nodevalues, sampling, structured, tree


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values. block_mesh: whether the mesh is split into blocks; corners: whether corner values are
    made."""

    down_sample: int = 1
    force_unstructured: bool = False
    tree: str = tree.NODE_MEDIAN
    max_depth: int = 40
    leaf_cells: int = 1024
    block_mesh: bool = False
    corners: bool = True


@dataclass
class Ingested:
    """What an ingest gives: voxels of a structured volume, or points, cells and fields, with a tree and its values, and
    blocks if they were asked for."""

    size: structured.Size
    voxels: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def ingest(voxels: DataFrame, size: structured.Size, options: Options = Options(), cell_size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Ingested:
    """A structured volume (x, y, z, value) taken as far as the options say; only unstructured meshes get a tree."""
    if options.down_sample > 1:
        voxels, size = structured.downsample(voxels, size, options.down_sample)
    if not options.force_unstructured:
        return Ingested(size, voxels)
    points, cells, fields = structured.to_unstructured(voxels, size)
    points = structured.scaled(points, cell_size)
    box = (0.0, 0.0, 0.0), tuple((s - 1) * float(c) for s, c in zip(size, cell_size, strict=True))
    nodes, leaf_cells = tree.build_tree(mesh.cell_bounds(cells, points), box, options.tree, options.leaf_cells, options.max_depth, points)
    ranges = nodevalues.node_ranges(nodes, nodevalues.leaf_ranges(leaf_cells, cells, fields, nodes.where("is_leaf")))
    out = {"points": points, "cells": cells, "fields": fields, "nodes": nodes, "leaf_cells": leaf_cells, "limits": mesh.limits(fields), "ranges": ranges}
    if options.corners:
        at_leaves = nodevalues.leaf_corners(nodes.where("is_leaf"), leaf_cells, sampling.geometry_of(cells, points), fields)
        out["corners"] = nodevalues.corner_values(nodes, at_leaves)
    if options.block_mesh:
        out["block_points"], out["block_cells"] = blocks.split_blocks(leaf_cells, cells)
        out["block_values"] = blocks.block_values(out["block_points"], fields)
    return Ingested(size, None, out)
