"""Frontiers of views as a stream: every request of a view is one update of its frontier.

The state of a view is its frontier (nodes with their boxes and what became of them in the last update), what its camera
looked like, the number of its last request, and requests that came before their turn. The tree itself is static: while
it is small (a count tells) every Python worker reads its splits and ranges once (``run``); beyond that, every micro-batch
joins the frontiers with the node table and keeps them as files (``run_by_tables``).
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from volmesh.common import checkpointed
from volmesh.operators import lod

#: What a view looks like; a change of any of these resets its states.
CAMERA = ("ex", "ey", "ez", "mat", "iso_name", "iso")
CAMERA_TYPES = "ex double, ey double, ez double, mat array<double>, iso_name string, iso double"
BOX = ("x0", "y0", "z0", "x1", "y1", "z1")
#: Bytes of a tree's splits and ranges that a task holds at most.
TREE_BYTES = 128 << 20
OUT = "view_id long, seq long, node_key long, state string"


def stored(nodes: DataFrame, ranges: DataFrame, limits: DataFrame, path: str) -> str:
    """Writes what the tasks need of a tree (a split and a range of each field for every node) to a shared folder."""
    split = F.when(~F.col("is_leaf"), F.col("split_val").cast("double")).alias("split")
    box = [F.when(F.col("node_key") == 1, F.col(b).cast("double")).alias(b) for b in BOX]
    for name, df in (("nodes", nodes.select("node_key", split, *box)), ("ranges", ranges.select("name", "node_key", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))), ("limits", limits.select("name", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))):
        df.coalesce(4).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def _table(path: str) -> pa.Table:
    found, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return dataset.dataset(name, filesystem=found, format="parquet").to_table()


@functools.cache
def _tree(path: str) -> Tree:
    """A tree, read once in a Python worker."""
    return Tree(path)


class Tree:
    """Splits and ranges of a tree by node key, from the files that ``stored`` writes."""

    def __init__(self, path: str) -> None:
        rows = _table(f"{path}/nodes").sort_by("node_key")
        self.keys, self.splits = (rows[c].to_numpy() for c in ("node_key", "split"))
        top = rows.slice(0, 1).to_pylist()
        self.root = tuple(top[0][b] for b in BOX) if top and top[0]["node_key"] == 1 else None
        self.ranges = {}
        for name, own in _table(f"{path}/ranges").to_pandas().groupby("name"):
            both = np.full((len(self.keys), 2), np.nan)
            both[np.searchsorted(self.keys, own["node_key"])] = own[["lo", "hi"]]
            self.ranges[name] = both
        self.limits = {r["name"]: (r["lo"], r["hi"]) for r in _table(f"{path}/limits").to_pylist() if r["name"] not in ("x", "y", "z")}

    def at(self, key: int) -> int:
        return int(np.searchsorted(self.keys, key))

    def split(self, key: int) -> float | None:
        """Where a node is split; None of a leaf."""
        value = self.splits[self.at(key)]
        return None if math.isnan(value) else float(value)

    def children(self, key: int, box: tuple) -> list[tuple[int, tuple]]:
        axis, at = (key.bit_length() - 1) % 3, self.split(key)
        return [(2 * key, (*box[: 3 + axis], at, *box[4 + axis :])), (2 * key + 1, (*box[:axis], at, *box[axis + 1 :]))]

    def first(self, budget: int) -> dict[int, tuple]:
        """Boxes of the frontier that expanding breadth first leaves."""
        if self.root is None:
            return {}
        front, todo, left = {1: self.root}, [1], max(0, math.ceil((budget - 3) / 2))
        for key in todo:
            if left and self.split(key) is not None:
                below = self.children(key, front.pop(key))
                front.update(below)
                todo += [k for k, _ in below]
                left -= 1
        return front

    def of_field(self, key: int, box: tuple, name: str | None, iso: float | None) -> float:
        if name is None:
            return 1.0
        if name in ("x", "y", "z"):
            i = "xyz".index(name)
            lo, hi, limits = box[i], box[i + 3], (self.root[i], self.root[i + 3])
        else:
            lo, hi = self.ranges[name][self.at(key)] if name in self.ranges else (math.nan, math.nan)
            limits = self.limits.get(name)
        if math.isnan(lo):
            return 1.0
        if iso is None:
            return 0.0
        if lo <= iso <= hi:
            return 1.0
        if limits is None:
            return 0.0
        above, below = (0.1 * (hi - limits[0]), iso - limits[0]) if hi < iso else (0.1 * (limits[1] - lo), limits[1] - iso)
        return float(above / below) if below else 0.0

    def score(self, view_id: int, key: int, box: tuple, camera: dict, seed: int = 1) -> float:
        """As ``lod.scores``."""
        if camera["iso_name"] is None and camera["mat"] is None:
            return int(hashlib.md5(f"{seed}:{view_id}:{key}".encode()).hexdigest()[:8], 16) / float(1 << 32)
        return _of_box(box, camera) * self.of_field(key, box, camera["iso_name"], camera["iso"])


def _of_box(box: tuple, camera: dict) -> float:
    if camera["mat"] is None or not _visible(box, camera["mat"]):
        return 0.0
    eye = [camera[c] for c in ("ex", "ey", "ez")]
    if any(e is None for e in eye):
        return math.inf
    extent = max(box[i + 3] - box[i] for i in range(3))
    away = 0.0
    for i in range(3):
        d = (box[i] + box[i + 3]) / 2 - eye[i]
        away += d * d
    return extent * extent / away if away else math.inf


def _visible(box: tuple, m: list[float]) -> bool:
    for c in range(8):
        p = [box[i + 3 * (c >> i & 1)] for i in range(3)]
        x, y, z, w = (((m[r] * p[0] + m[4 + r] * p[1]) + m[8 + r] * p[2]) + m[12 + r] for r in range(4))
        if w and abs(x / w) <= 1 and abs(y / w) <= 1 and z / w >= 0:
            return True
    return False


def update(front: dict[int, tuple], states: dict[int, str], score: dict[int, float], leaf: dict[int, bool], budget: int) -> tuple[list[int], list[int]]:
    """Nodes to split and parents whose children are merged, as ``lod.step`` finds them for one view."""
    most = math.ceil(budget * 0.005)
    place = {k: i for i, k in enumerate(sorted(front, key=lambda k: (0 if math.isnan(score[k]) else 1, -score[k] if not math.isnan(score[k]) else 0, k)))}
    splits = [k for k in place if not leaf[k] and states[k] != "MERGED"][:most]
    if not splits:
        return [], []
    last, parents = max(place[k] for k in splits), {k // 2 for k in splits}
    pairs = [k // 2 for k in place if k > 1 and k % 2 == 0 and k + 1 in place and "SPLIT" not in (states[k], states[k + 1])]
    merges = [p for p in pairs if min(place[2 * p], place[2 * p + 1]) > last and p not in parents]
    merges.sort(key=lambda p: -max(place[2 * p], place[2 * p + 1]))
    n = min(len(splits), len(merges), most)
    return splits[:n], merges[:n]


class Frontiers(StatefulProcessor):
    """State of one view: node -> box and state; the last request; requests that wait for those before them."""

    def __init__(self, tree: str, budget: int) -> None:
        self.tree, self.budget = tree, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.front = handle.getMapState("front", "node_key long", "state string, " + ", ".join(f"{b} double" for b in BOX))
        self.last = handle.getValueState("last", "seq long, " + CAMERA_TYPES)
        self.waiting = handle.getMapState("waiting", "seq long", "ts long, " + CAMERA_TYPES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for r in batch.to_dict("records"):
                seq, due = int(r["seq"]), int(pd.Timestamp(r["ts"]).timestamp() * 1000)
                if not self.waiting.containsKey((seq,)) and seq > self._seq():
                    self.waiting.updateValue((seq,), (due, *(_plain(r[c]) for c in CAMERA)))
                    if seq > self._seq() + 1:  # others are still to come: it waits for them until the watermark is past it
                        self.handle.registerTimer(due)
        yield from self._answered(key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._answered(key, expiredTimerInfo.getExpiryTimeInMs())

    def _seq(self) -> int:
        return int(self.last.get()[0]) if self.last.exists() else 0

    def _answered(self, key, due: int | None) -> Iterator[pd.DataFrame]:
        """Answers waiting requests in turn: those that follow on the last one, and up to the last that is due."""
        waiting = sorted((int(k[0]), v) for k, v in self.waiting.iterator())
        upto = max((s for s, v in waiting if due is not None and v[0] <= due), default=0)
        for seq, value in waiting:
            if seq > self._seq() + 1 and seq > upto:
                break
            self.waiting.removeKey((seq,))
            yield self._step(int(key[0]), seq, dict(zip(CAMERA, value[1:], strict=True)))

    def _step(self, view_id: int, seq: int, camera: dict) -> pd.DataFrame:
        tree = _tree(self.tree)
        known = {int(k[0]): (v[0], tuple(v[1:])) for k, v in self.front.iterator()}
        before = dict(zip(CAMERA, self.last.get()[1:], strict=True)) if self.last.exists() else None
        front = {k: box for k, (_, box) in known.items()} or tree.first(self.budget)
        same = before is not None and all(_plain(before[c]) == _plain(camera[c]) for c in CAMERA)
        states = {k: known[k][0] if same and k in known else "NONE" for k in front}
        score = {k: tree.score(view_id, k, box, camera) for k, box in front.items()}
        splits, merges = update(front, states, score, {k: tree.split(k) is None for k in front}, self.budget)
        states = dict.fromkeys(front, "NONE")
        for parent in merges:
            low, high = front.pop(2 * parent), front.pop(2 * parent + 1)
            front[parent], states[parent] = (*low[:3], *high[3:]), "MERGED"
        for k in splits:
            for child, box in tree.children(k, front.pop(k)):
                front[child], states[child] = box, "SPLIT"
        for k in known.keys() - front.keys():
            self.front.removeKey((k,))
        for k, box in front.items():
            if known.get(k) != (states[k], box):
                self.front.updateValue((k,), (states[k], *map(float, box)))
        self.last.update((seq, *(camera[c] for c in CAMERA)))
        keys = sorted(front)
        return pd.DataFrame({"view_id": view_id, "seq": seq, "node_key": keys, "state": [states[k] for k in keys]})

    def close(self) -> None:
        pass


def _plain(value):
    """A value as the state holds it: lists of floats, None for what is missing."""
    if isinstance(value, (list, tuple, np.ndarray)):
        return [float(v) for v in value]
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


def fits(nodes: DataFrame, ranges: DataFrame) -> bool:
    return nodes.count() * 16 + ranges.count() * 24 <= TREE_BYTES


def frontiers(requests: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, budget: int, store: str, wait: str = "1 minute") -> DataFrame:
    """view_id, seq, node_key, state of a stream of requests (ts, view_id, seq, ex, ey, ez, mat, iso_name, iso): every
    view's frontier after each of its requests.

    Requests of a view are numbered from 1 on and answered in that order, whatever order they come in: one waits for
    those before it until the watermark (``wait`` behind the newest ts) is past its ts. One that comes after a later one
    has been answered, or again, is dropped. The session has to use the RocksDB state store. store: a folder that all
    executors share, for the tree (a processor of state can't be given broadcast variables).
    """
    if not fits(nodes, ranges):
        raise ValueError("the tree is too large for tasks to hold; use run_by_tables")
    tree = stored(nodes, ranges, limits, store)
    keyed = requests.withWatermark("ts", wait).groupBy("view_id")
    return keyed.transformWithStateInPandas(Frontiers(tree, budget), OUT, "Append", "EventTime")


def run(requests: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, budget: int, out: str, checkpoint: str, wait: str = "1 minute"):
    """Writes ``frontiers`` to Parquet files, and goes on from the checkpoint after a restart."""
    found = frontiers(requests, nodes, ranges, limits, budget, f"{checkpoint.rstrip('/')}-tree", wait)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stepped(now: DataFrame, before: DataFrame, views: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, budget: int) -> DataFrame:
    """view_id, node_key, state: the frontiers (of that form) of views after a request each.

    before: view_id and CAMERA of earlier requests. Views that have no frontier get the first one.
    """
    first = lod.frontier(nodes, budget).select("node_key")
    new = views.select("view_id").join(now.select("view_id").distinct(), "view_id", "left_anti")
    started = now.unionByName(new.crossJoin(F.broadcast(first)).select("view_id", "node_key", F.lit("NONE").alias("state")))  # budget nodes
    states = checkpointed(lod.reset(started.join(views.select("view_id"), "view_id", "left_semi"), before, views.select("view_id", *CAMERA)))
    front = nodes.join(states, "node_key")
    scored = checkpointed(lod.scores_of(front, views, nodes, ranges, limits).join(states, ["view_id", "node_key"]))
    return lod.applied(scored, *lod.step(scored, budget))


def run_by_tables(requests: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, budget: int, out: str, checkpoint: str):
    """The same for trees of any size: every micro-batch joins frontiers with the node table. Frontiers and cameras are
    kept in ``out`` by batch, each made from the one before, so that a batch that is run again gives the same.

    Requests of a batch are answered in their order; one that comes after a later one of its view is dropped, and none
    waits.
    """
    spark = nodes.sparkSession
    path = lambda name, batch: f"{out}/{name}/batch={batch}"

    def kept(name: str, batch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path(name, batch)) if batch >= 0 else spark.createDataFrame([], schema)

    def answer(rows: DataFrame, batch: int) -> None:
        front = kept("state", batch - 1, "view_id long, node_key long, state string")
        last = kept("cameras", batch - 1, f"view_id long, seq long, {CAMERA_TYPES}")
        fresh = rows.dropDuplicates(["view_id", "seq"]).join(last.select("view_id", F.col("seq").alias("done")), "view_id", "left").where("done IS NULL OR seq > done")
        turns = checkpointed(fresh.withColumn("turn", F.row_number().over(Window.partitionBy("view_id").orderBy("seq"))).drop("done"))
        answers = []
        for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
            views = turns.where(F.col("turn") == turn).select("view_id", "seq", *CAMERA)
            new = stepped(front, last.select("view_id", *CAMERA), views, nodes, ranges, limits, budget)
            front = checkpointed(front.join(views, "view_id", "left_anti").unionByName(new))
            last = checkpointed(last.join(views, "view_id", "left_anti").unionByName(views))
            answers.append(front.join(views.select("view_id", "seq"), "view_id").select("view_id", "seq", "node_key", "state"))
        front.write.mode("overwrite").parquet(path("state", batch))
        last.write.mode("overwrite").parquet(path("cameras", batch))
        empty = spark.createDataFrame([], OUT)
        for part in answers:
            empty = empty.unionByName(part)
        empty.write.mode("overwrite").parquet(path("answers", batch))

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
