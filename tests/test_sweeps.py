"""Sweeps write each output once and are those of single trees."""


from volmesh.operators import structured, sweeps, tree

SIZE, BOX = (6, 5, 5), ((0.0,) * 3, (5.0, 4.0, 4.0))


def test_a_second_run_starts_no_tree(spark, tmp_path, monkeypatch):
    bounds = structured.grid_cell_bounds(spark, SIZE).cache()
    points = structured.grid_points(spark, SIZE).cache()
    out, targets, strategies = str(tmp_path / "sweep"), [200, 50, 100], (tree.NODE_MEDIAN, tree.VERT_AVERAGE)
    built = []
    real = tree.build_tree
    monkeypatch.setattr(tree, "build_tree", lambda *a, **k: built.append(a[2:4]) or real(*a, **k))
    run = lambda **k: sorted(map(tuple, sweeps.sweep(bounds, BOX, targets, strategies, out=out, points=points, max_depth=5, **k).collect()))
    first = run()
    assert built == [(tree.NODE_MEDIAN, 50), *((tree.VERT_AVERAGE, t) for t in (50, 100, 200))]
    assert run() == first and len(built) == 4
    for s, t, nodes, leaves, leaf_cells, *_ in first:
        own, cells = real(bounds, BOX, s, t, 5, points)
        assert (own.count(), own.where("is_leaf").count(), cells.count()) == (nodes, leaves, leaf_cells)
    targets.append(150)
    more = run()
    assert len(more) == 8 and set(first) < set(more) and built[4:] == [(tree.NODE_MEDIAN, 150), (tree.VERT_AVERAGE, 150)]
    assert run(force=True) == more and len(built) == 6 + 5


def test_an_output_that_was_not_finished_is_made_again(spark, tmp_path):
    out = str(tmp_path / "sweep")
    (tmp_path / "sweep" / "node_median-9" / "_temporary").mkdir(parents=True)
    assert not sweeps.written(spark, out, tree.NODE_MEDIAN, 9)
    got = sweeps.sweep(structured.grid_cell_bounds(spark, SIZE), BOX, [9], (tree.NODE_MEDIAN,), out=out, max_depth=3).collect()
    assert len(got) == 1 and got[0].max_depth == 3
