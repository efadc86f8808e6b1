"""Few short rows take few tasks, however many partitions there are, and the same results come from any number."""

import random

import pytest
from pyspark.sql import functions as F

from volmesh.llm import common, components, similar, simhash


@pytest.fixture
def tasks(spark):
    """Runs a function with 60 partitions, none of them merged by Spark; gives its value and how many tasks it took."""
    names = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {n: spark.conf.get(n) for n in names}, spark.sparkContext

    def run(action):
        group = f"tasks-{random.random()}"
        context.setJobGroup(group, group)
        value = action()
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return value, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)

    for n, v in names.items():
        spark.conf.set(n, v)
    yield run
    for n, v in before.items():
        spark.conf.set(n, v)
    context.setLocalProperty("spark.jobGroup.id", None)


def plain_components(links):
    top = {}
    for a, b in links:
        if a is not None and b is not None:
            x, y = (top.setdefault(n, {n}) for n in (a, b))
            x |= y
            top.update(dict.fromkeys(x, x))
    return {n: min(group) for n, group in top.items()}


@pytest.mark.parametrize("part_rows", [7, common.PART_ROWS])
def test_components_of_random_links(spark, monkeypatch, part_rows):
    monkeypatch.setattr(components, "gathered", lambda df, rows: common.gathered(df, rows, part_rows))
    rng = random.Random(part_rows)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(55)] + [(200, 200), (None, 3), (201, None)] + [(300 + i, 301 + i) for i in range(30)]
    links += links[:9]
    rows = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == plain_components(links)


def test_few_links_take_few_tasks(spark, tasks):
    links = [(i, i + 1) for i in range(100)]
    got, n = tasks(lambda: components.components(spark.createDataFrame(links, "a long, b long").repartition(60)).collect())
    assert {r.component for r in got} == {0} and len(got) == 101
    assert n < 1500  # 835; 5176 when every step of every round had 60 partitions


def test_near_copies_of_few_texts_take_few_tasks(spark, tasks):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 3 * (i % 4)], f"x{i}", *words[3 * (i % 4) :], *(f"{i % 5}y{j}" for j in range(200))])) for i in range(40)], "doc_id long, text string")
    got, n = tasks(lambda: similar.near_copies(docs).collect())
    assert len({r.component for r in got}) == 5
    assert n < 5000  # 3212; 8424 before


def test_exploded_cells_and_bands_are_not_broadcast(spark, monkeypatch):
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan_of(simhash._values(spark.range(50).select(F.col("id").alias("fp"))))
    monkeypatch.setattr(similar, "checkpointed", lambda df: df)
    of = lambda name: F.col("id").alias(name)
    bands = spark.range(50).select(of("shape"), of("size"), of("fp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("band"))
    assert "Broadcast" not in plan_of(similar._with_hubs(bands, 50))
    sets = spark.range(50).select(of("shape"), F.array("id").alias("hashes"))
    pairs = spark.range(50).select(of("a"), (F.col("id") + 1).alias("b"))
    assert plan_of(similar._verified(pairs, sets)).count("SortMergeJoin") == 2  # only the counts of copies are broadcast


def test_cells_stay_in_tasks_when_their_fingerprints_are_few(spark):
    found = simhash.links(spark.range(3000).select(F.xxhash64("id").alias("fp")).groupBy("fp").count().select("fp"))
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
