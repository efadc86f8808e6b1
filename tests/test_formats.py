"""Data sources: rows equal to those of the byte-range readers, filters that reach the bytes, files in parts."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not
from pyspark.sql.types import StructType

from volmesh.operators import mesh, structured
from volmesh.sources import binary, formats, parts

SIZE = (5, 4, 6)


@pytest.fixture
def pushing(spark):
    formats.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "v.raw").write_bytes(b"head" + np.arange(120, dtype="<i2").tobytes())
    return str(tmp_path / "v.raw")


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def raw_reader(path, schema="x int, y int, z int, value float", **options):
    return formats.PushedRawReader(StructType.fromDDL(schema), {"path": path, "dtype": "<i2", "size": "5,4,6", "offset": "4", **options})


@pytest.mark.parametrize("condition", ["true", "z = 3", "z > 1 AND z <= 3 AND y >= 2", "x < 2 AND z IN (0, 4)", "z = 9", "x = 1 OR z = 2", "z > 2 AND value > 80", "y IS NULL", "z <> 3", "z > 1.5", "z IN (5, NULL)"])
def test_raw_volume(pushing, raw, condition):
    made = pushing.read.format("volmesh_raw").option("pushdown", True).option("dtype", "<i2").option("size", "5,4,6").option("offset", 4).load(raw)
    plain = binary.read_raw_volume(pushing, raw, "<i2", SIZE, 4)
    assert made.columns == plain.columns and rows(made.where(condition)) == rows(plain.where(condition))


def test_filters_reach_the_bytes(pushing, raw, monkeypatch):
    made = pushing.read.format("volmesh_raw").option("pushdown", True).option("dtype", "<i2").option("size", "5,4,6").option("offset", 4).load(raw).where("z >= 2 AND z < 4 AND y = 1")
    text = plan(made)
    assert "volmesh_raw" in text and "Filter (" not in text  # nothing is left for Spark

    reader = raw_reader(raw)
    left = [Not(EqualTo(("z",), 1)), GreaterThan(("value",), 3.0), In(("x",), (1, 3))]
    assert list(reader.pushFilters([IsNotNull(("z",)), GreaterThan(("z",), 1), LessThanOrEqual(("z",), 3), EqualTo(("y",), 1), *left])) == left
    read = []
    monkeypatch.setattr(formats.Bytes, "read_at", lambda self, n, at, real=formats.Bytes.read_at: read.append((at, n)) or real(self, n, at))
    got = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert read == [(4 + 2 * (20 * z + 5), 10) for z in (2, 3)]  # two lines of five voxels
    assert [r["x"] for b in got for r in b] == [1, 2, 3] * 2
    nothing = raw_reader(raw, z_from="4", z_to="3")
    assert [b for p in nothing.partitions() for b in nothing.read(p)] == []


def test_tasks_and_batches(monkeypatch, raw):
    monkeypatch.setattr(formats, "TASK_ROWS", 17)
    monkeypatch.setattr(formats, "BATCH_ROWS", 4)
    reader = raw_reader(raw, y_from="1", y_to="2", z_to="4")
    assert len(reader.partitions()) == 6
    found = [(r["x"], r["y"], r["z"], r["value"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert found == [(x, y, z, float(x + 5 * y + 20 * z)) for z in range(5) for y in (1, 2) for x in range(5)]


def test_schema_prunes_columns(pushing, raw):
    reader = raw_reader(raw, "value double, z long")
    assert next(reader.read(reader.partitions()[0])).schema.names == ["value", "z"]
    made = pushing.read.format("volmesh_raw").option("pushdown", True).option("dtype", "<i2").option("size", "5,4,6").option("offset", 4).schema("z long, value double").load(raw)
    assert made.where("z = 5").agg(F.sum("value")).first()[0] == sum(range(100, 120))


def test_volumes_in_parts(pushing, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 7)
    path = f"{tmp_path}/volume"
    volume = pushing.range(120).select((F.col("id") % 5).alias("x"), (F.expr("id div 5") % 4).alias("y"), F.expr("id div 20").alias("z"), F.col("id").cast("double").alias("value"))
    odd = pushing.createDataFrame([(0, 0, 0, 7.0), (0, 0, 0, 3.0), (1, 0, 0, None), (9, 0, 0, 1.0), (-1, 0, 0, 1.0), (None, 0, 0, 1.0), (0, 0, 6, 1.0)], "x long, y long, z long, value double")
    formats.write_raw_volume(volume.where("id > 2 AND id NOT BETWEEN 40 AND 79").union(odd), path, SIZE)
    expected = [7.0, 0.0, 0.0, *map(float, range(3, 40)), *[0.0] * 40, *map(float, range(80, 120))]
    values = lambda df: [r.value for r in df.orderBy("z", "y", "x").collect()]
    assert values(binary.read_raw_volume(pushing, path, "<f4", SIZE)) == expected
    made = pushing.read.format("volmesh_raw").option("pushdown", True).option("size", "5,4,6").load(path)
    assert values(made) == expected and values(made.where("z = 1 AND y = 3")) == expected[35:40]
    # Written anew, the old parts go; a path with a scheme is the same folder.
    formats.write_raw_volume(volume, f"file://{path}", SIZE)
    assert values(pushing.read.format("volmesh_raw").option("pushdown", True).option("size", "5,4,6").load(f"file:{path}")) == list(map(float, range(120)))
    listed = parts._listing(*parts.located(path))
    assert {p.name for p in (tmp_path / "volume").iterdir() if p.name.startswith("part-")} == {name for _, _, name in listed}


def test_parts_have_to_meet(spark, tmp_path):
    with pytest.raises(Exception, match="missing or there twice"):
        parts.write_parts(spark.createDataFrame([(0, bytearray(b"ab")), (3, bytearray(b"c"))], "at long, piece binary").coalesce(1), f"{tmp_path}/gap")
    with pytest.raises(FileNotFoundError):
        parts.Bytes(f"{tmp_path}/none")
    parts.write_parts(spark.createDataFrame([], "at long, piece binary"), f"{tmp_path}/empty")
    assert parts.Bytes(f"{tmp_path}/empty").read_at(5, 0) == b""


def test_lost_tasks_leave_nothing(tmp_path):
    """A task that ran twice wrote two parts; only the one whose message was committed counts."""
    import pyarrow as pa

    writer = parts.PartsWriter(f"{tmp_path}/file", True)
    batch = lambda at, piece: pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "piece": pa.array([piece], pa.binary())})
    writer.write(iter([batch(0, b"lost")]))
    writer.commit([writer.write(iter([batch(4, b"last")])), None, writer.write(iter([batch(0, b"firs")]))])
    assert parts.Bytes(f"{tmp_path}/file").read_at(100, 2) == b"rslast"
    with pytest.raises(ValueError, match="there already"):
        parts.PartsWriter(f"{tmp_path}/file", False).commit([])
    gone = writer.write(iter([batch(0, b"gone")]))
    writer.abort([gone, None])
    assert not (tmp_path / "file" / gone.parts[0][2]).exists()


def test_ugrid(pushing, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 10)
    path = f"{tmp_path}/mesh"
    points = structured.grid_points(pushing, SIZE)
    cells = structured.grid_tets(pushing, SIZE, 6).select("cell_id", *mesh.VERTICES)
    for order in "<>":
        formats.write_ugrid(points, cells, path, order)
        load = lambda table, order=order: pushing.read.format("volmesh_ugrid").option("pushdown", True).option("table", table).option("byte_order", order).load(path)
        assert rows(load("points")) == rows(points.select("point_id", *(F.col(a).cast("double") for a in "xyz")))
        tets = load("elements").where("section = 'tet'")
        assert rows(mesh.tetrahedra(tets).select("cell_id", *mesh.VERTICES)) == rows(cells)
        assert load("points").where("point_id BETWEEN 30 AND 32").count() == 3
        assert load("elements").where("section IN ('hex', 'tri')").count() == 0 == load("points").where("point_id = 500").count()
        plain = binary.read_ugrid(pushing, path, order)
        assert rows(plain[0]) == rows(load("points")) and rows(plain[2]) == rows(load("elements"))
    formats.write_ugrid(points.limit(0), cells.limit(0), path)
    assert pushing.read.format("volmesh_ugrid").option("pushdown", True).load(path).count() == 0


def test_ugrid_sections(pushing, tmp_path):
    """All kinds of elements, with surface ids between faces and volume elements."""
    counts = [9, 2, 1, 1, 1, 0, 1]
    faces, solids = np.arange(10), np.arange(4 + 5 + 8)
    content = np.array(counts, "<i4").tobytes() + np.zeros(27, "<f4").tobytes() + faces.astype("<i4").tobytes() + np.full(3, 99, "<i4").tobytes() + solids.astype("<i4").tobytes()
    (tmp_path / "m.ugrid").write_bytes(content)
    made = pushing.read.format("volmesh_ugrid").option("pushdown", True).option("table", "elements").load(f"{tmp_path}/m.ugrid")
    assert rows(made) == rows(binary.read_ugrid(pushing, f"{tmp_path}/m.ugrid")[2])
    assert [(r.elem_id, list(r.verts)) for r in made.where("section = 'tri' AND elem_id > 0").collect()] == [(1, [3, 4, 5])]
    assert [list(r.verts) for r in made.where("section = 'hex'").collect()] == [list(range(9, 17))]


def test_volume_data(pushing, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 3)
    monkeypatch.setattr(formats, "BLOCK_ROWS", 3)
    values = pushing.createDataFrame([(t, p, n, float(100 * t + 10 * p + i)) for t in range(3) for p in range(8) for i, n in enumerate(("a", "b")) if (t, p) != (1, 4)], "t int, point_id long, name string, value double")
    path = f"{tmp_path}/data"
    formats.write_volume_data(values.union(pushing.createDataFrame([(0, 0, "c", 1.0), (3, 0, "a", 1.0), (0, 8, "a", 1.0), (None, 0, "a", 1.0)], values.schema)), path, ["a", "b"], 8, 3, ">")
    expected = rows(values.union(pushing.createDataFrame([(1, 4, "a", 0.0), (1, 4, "b", 0.0)], values.schema)))
    assert rows(binary.read_volume_data(pushing, path, ["a", "b"], ">")) == expected
    made = pushing.read.format("volmesh_data").option("pushdown", True).option("names", "a,b").option("byte_order", ">").load(path)
    assert rows(made) == expected
    some = made.where("t >= 1 AND name = 'b' AND point_id IN (3, 4) AND value < 250")
    assert rows(some) == [r for r in expected if r[0] >= 1 and r[2] == "b" and r[1] in (3, 4) and r[3] < 250]
    assert made.where("t = 7").count() == 0 == made.where("name = 'c'").count()
    with pytest.raises(ValueError, match="2 variables, not 1"):
        formats.VolumeDataReader(StructType.fromDDL("t int"), {"path": path, "names": "a", "byte_order": ">"})
    (tmp_path / "x.bin").write_bytes(bytes(16))
    with pytest.raises(ValueError, match="begin with"):
        formats.VolumeDataReader(StructType.fromDDL("t int"), {"path": f"{tmp_path}/x.bin", "names": "a"})


def test_load_pushes_where_the_session_does(pushing, raw):
    made = formats.load(pushing, "volmesh_raw", raw, "value double, z int", dtype="<i2", size="5,4,6", offset=4).where("z = 3")
    assert "Filter (" not in plan(made) and made.agg(F.sum("value")).first()[0] == sum(range(60, 80))


def test_without_pushdown(spark, raw):
    load = lambda **o: formats.load(spark, "volmesh_raw", raw, dtype="<i2", size="5,4,6", offset=4, **o)
    assert load().where("z = 3").count() == 20 == load(z_from=2, z_to=2).count()
