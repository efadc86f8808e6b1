"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to target shares of each of the three in turn;
a cell's probability is proportional to its raked weight over the tokens it has, and documents are sampled by
it. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking between two looks at the gaps (each fits all three marginals in turn), looks at most, and the gap
#: of a share at which raking ends.
ROUNDS, LOOKS, TOLERANCE = 10, 10, 1e-3
#: Target shares are the present ones to this power (1: as they are, 0: all alike), made to sum to 1.
TEMPERATURE = 0.7
#: Share of the tokens that is kept, if no cell's probability comes over 1 by that.
KEEP = 0.9
#: Up to so many cells their probabilities are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 20_000


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: notice, record, contact, note or article."""
    return (
        F.when(F.regexp_like(text, F.lit("[Ll]icen[sc]e|[Cc]opyright")), "notice")
        .when(50 * (F.length(text) - F.length(F.replace(text, F.lit("|")))) > F.length(text), "record")
        .when(F.instr(text, "@") > 0, "contact")
        .when(F.length(text) < 1000, "note")
        .otherwise("article")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic and mix_tokens (words by ASCII white space). Nulls are ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.withColumns({"mix_source": name("source"), "mix_lang": name("lang"), "mix_topic": topic_of(text) if topic is None else topic, "mix_tokens": tokens})


def targets(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """mix_<dimension>, share: the present shares of the tokens to a power, made to sum to 1."""
    present = cells.groupBy(f"mix_{dimension}").agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    powered = present.select(f"mix_{dimension}", F.pow("tokens", F.lit(temperature)).alias("power"))
    total = powered.agg(F.sum("power")).first()[0] or 1.0
    return powered.select(f"mix_{dimension}", (F.col("power") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, marginals: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (mix_source, mix_lang, mix_topic, tokens) with weight: raked to the shares in marginals.

    Values without a share, or with share 0, get weight 0. A round's sums are made of weights alone, so cells
    that a marginal can't reach stay as far from it as they are. After so many rounds the largest gap is looked at:
    raking goes on until it is small, or hardly shrinks any more.
    """
    names = [f"mix_{d}" for d in DIMENSIONS]
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.select(*names, "tokens", F.col("tokens").cast("double").alias("weight"))
    for d in DIMENSIONS:
        now = now.join(marginals[d].select(f"mix_{d}", F.col("share").alias(f"{d}_share")), f"mix_{d}", "left").fillna({f"{d}_share": 0.0})
    now, before = checkpointed(now), None
    for _ in range(LOOKS):
        for round_ in range(rounds):
            for d in DIMENSIONS:
                sum_here = F.sum("weight").over(Window.partitionBy(f"mix_{d}"))
                now = now.withColumn("weight", F.when(sum_here > 0, F.col("weight") * F.col(f"{d}_share") * F.lit(float(total)) / sum_here).otherwise(0.0))
            if round_ % 5 == 4 or round_ == rounds - 1:
                now = checkpointed(now)
        gap = largest_gap(now, total)
        if gap <= TOLERANCE or before is not None and gap > 0.9 * before:
            break
        before = gap
    return now.select(*names, "tokens", "weight")


def largest_gap(raked: DataFrame, total: int) -> float:
    """How far a value's share of the weights is from its target at most."""
    gaps = [raked.groupBy(f"mix_{d}").agg(F.abs(F.sum("weight") / max(1, total) - F.max(f"{d}_share")).alias("gap")).select("gap") for d in DIMENSIONS]
    return reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0] or 0.0


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that a document keeps whatever it is sampled for; a null doc_id has 0."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 8)
    return F.coalesce(F.conv(digits, 16, 10).cast("double") / 4294967296, F.lit(0.0))


def mix(docs: DataFrame, marginals: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, mix_probability and mix_kept.

    marginals: per dimension mix_<dimension>, share; by default ``targets``. A cell's probability is keep times its
    weight over its tokens. keep is lowered until no probability is over 1, so that the expected shares of what is kept
    are the raked ones. Cells without tokens (empty texts) have probability keep. Repeated rows share their fate.
    Null sources, languages and texts count as ''. Texts of any length are counted whole. Rows of one doc_id share their
    random number, and one that equals the probability isn't kept. An empty table gives no rows. Columns of docs with these
    names are replaced.
    """
    rows = with_cells(docs.drop(*(f"mix_{x}" for x in (*DIMENSIONS, "tokens", "probability", "kept"))))
    names = [f"mix_{d}" for d in DIMENSIONS]
    cells = checkpointed(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")))
    marginals = {d: targets(cells, d) for d in DIMENSIONS} if marginals is None else marginals
    raked = checkpointed(rake(cells, marginals, rounds))
    most = raked.where("tokens > 0").agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 0.0
    keep = min(keep, 1 / most) if most > 0 else keep
    chances = raked.select(*names, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(keep) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(keep)).alias("mix_probability"))
    small = cells.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(chances) if small else chances, names)
    return joined.withColumn("mix_kept", chance(F.col("doc_id"), seed) < F.round("mix_probability", 9))
