"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame operations and Spark's own boosted trees.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sampled


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: URLs of either verdict that the trees are fitted on at most, chosen by a hash over all of them.
MOST_FITTED = 20_000
#: Up to so many distinct suffixes their statistics are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 10_000
#: Rows that a suffix's statistics count as having beforehand, at the mean of all.
SMOOTHING = 20
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy", "parameters", "secure", "suffix_blocked", "suffix_pages")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path. host: after the first ://, up to / ? # or the end, A-Z in lower case; path: then
    up to ? # or the end. Both are empty where there is no :// or no url."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    raw = F.regexp_extract("after", r"^[^/?#]*", 0)
    return (
        pages.select(F.col("page_id"), url.alias("url"))
        .withColumn("after", after)
        .withColumn("raw", raw)
        .select("page_id", "url", F.translate("raw", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.regexp_extract(F.expr("substring(after, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))
    )


def rule_of(rules: Sequence[UrlRule]) -> Column:
    """Of the rules that fit host and path, the longest as struct<rule, verdict>; null if none fits."""
    host, path = F.col("host"), F.col("path")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_features(pages: DataFrame) -> DataFrame:
    """Lexical features of url, host and path, and the host's suffix (its last label)."""
    length = F.length("url")
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    chars = F.split("url", "")
    # Of each distinct character, its share by what its removal leaves.
    entropy = F.aggregate(
        F.transform(F.array_distinct(F.filter(chars, lambda c: c != "")), lambda c: (length - F.length(F.replace("url", c))) / length),
        F.lit(0.0),
        lambda total, share: total - share * F.log2(share),
    )
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return (
        pages.withColumn("url_length", length.cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", count(F.col("path"), "/").cast("double"))
        .withColumn("host_labels", count(F.col("host"), ".").cast("double"))
        .withColumn("digit_ratio", F.when(length > 0, F.length(F.regexp_replace("url", "[^0-9]", "")) / length).otherwise(0.0))
        .withColumn("hyphens", count(F.col("url"), "-").cast("double"))
        .withColumn("entropy", F.coalesce(entropy, F.lit(0.0)))
        .withColumn("parameters", F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0))
        .withColumn("secure", F.col("url").startswith("https:").cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )


def _joined(rows: DataFrame, stats: DataFrame) -> DataFrame:
    small = stats.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(stats) if small else stats, "suffix", "left")


def judge(pages: DataFrame, rules: Sequence[UrlRule], most_fitted: int = MOST_FITTED) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), block_score per row of pages.

    URLs that a rule fits are the labelled ones: their verdict is the rule's, and the trees learn from them.
    All others get the trees' verdict. If the labelled URLs know but one verdict, it is everyone's; without
    labelled URLs everything is allowed. Null URLs have empty parts, null page_ids stay; repeated rows are judged alike,
    URLs of any length whole. An empty table gives no rows; other columns of pages take no part, whatever their names.
    """
    urls = with_features(with_parts(pages)).withColumn("fit", rule_of(rules))
    urls = urls.withColumn("blocked", (F.col("fit.verdict") == "block").cast("double"))
    by_suffix = urls.where("blocked IS NOT NULL").groupBy("suffix").agg(F.count("*").alias("pages"), F.sum("blocked").alias("blocks"))
    by_suffix = checkpointed(by_suffix)
    total = by_suffix.agg(F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks")).first()
    pages_in, blocks = total.pages or 0, total.blocks or 0.0
    result = lambda df, score: df.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
    if not 0 < blocks < pages_in:
        return result(urls, F.lit(1.0 if blocks else 0.0))
    mean = blocks / pages_in
    smoothed = lambda blocks, pages: (blocks + SMOOTHING * mean) / (pages + SMOOTHING)
    # A labelled URL's own verdict takes no part in its suffix's statistics.
    own, one = F.coalesce("blocked", F.lit(0.0)), F.when(F.col("blocked").isNull(), 0.0).otherwise(1.0)
    full = _joined(urls, by_suffix).withColumns({
        "suffix_blocked": smoothed(F.coalesce("blocks", F.lit(0.0)) - own, F.coalesce("pages", F.lit(0)) - one),
        "suffix_pages": F.log1p(F.coalesce("pages", F.lit(0)) - one),
    })
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    labelled = full.where("blocked IS NOT NULL").select("blocked", "features", "url")
    sizes = {0.0: pages_in - int(blocks), 1.0: int(blocks)}
    parts = [sampled(labelled.where(F.col("blocked") == v), most_fitted, n, "url") for v, n in sizes.items()]
    sample = checkpointed(parts[0].union(parts[1]).select("blocked", "features"))
    model = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=12, maxDepth=3, stepSize=0.3, seed=1, maxBins=32).fit(sample)
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(full)
    return result(judged, vector_to_array("probability")[1])
