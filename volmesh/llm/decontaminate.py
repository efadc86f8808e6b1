"""Benchmark decontamination: windows of test items, broadcast as a hash set, looked up at every window of a document.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z is put in lower case. A window is ``n`` consecutive
words of an item, or all of a shorter item's. The set's rows are found by a 64-bit hash and their words compared.
A set that is larger than a broadcast may be is taken in blocks, each looked up in all documents.

Everything here is made of built-in functions.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_KEY, checkpointed

#: Words as they stand in a text, before A-Z is put in lower case; fixed value.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a window; bytes of windows that are broadcast at a time, and what a row costs beside its words.
WINDOW, BLOCK_BYTES, ROW_BYTES = 10, 32 << 20, 64
#: Windows that are cut from an array of words at a time.
PIECE = 512


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text; none of null."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(words: Column, n: int, most: int | None = None) -> Column:
    """struct<start, gram> of every ``n`` consecutive words (of the first ``most`` starts); none in fewer."""
    last = F.size(words) - n if most is None else F.least(F.size(words) - n, F.lit(most - 1))
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, length, gram: the distinct windows of each item; items without item_id or words have none."""
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("words").alias("length"), F.array_join("words", " ").alias("gram")))
    windows = F.explode(F.when(F.size("words") < n, whole).otherwise(windows_of(F.col("words"), n))).alias("w")
    return items.select("item_id", windows).select("item_id", "w.length", "w.gram").distinct()


def _seen(docs: DataFrame, lengths: list[int], *, rows_too: bool) -> DataFrame:
    """doc_id, text_key, n_words, start, length, gram: every window of these lengths, and (rows_too) for every row of docs
    one with start -1.

    Words are cut into pieces of PIECE first, each with the words that its last windows need, so that no array of
    windows is longer than that, however long a text is.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias(TEXT_KEY), words_of(text).alias("all"))
    longest = max(lengths, default=1)
    bases = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(PIECE))
    cut = F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice("all", b + 1, PIECE + longest - 1).alias("words")))
    pieces = rows.select("doc_id", TEXT_KEY, F.size("all").cast("long").alias("n_words"), F.explode(cut).alias("p")).select("doc_id", TEXT_KEY, "n_words", "p.base", "p.words")
    none = F.array().cast("array<struct<start:int,length:int,gram:string>>")
    head = F.when(F.lit(rows_too) & (F.col("base") == 0), F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit("").alias("gram")))).otherwise(none)
    every = F.concat(head, *(windows_of(F.col("words"), m, PIECE) for m in lengths))
    return pieces.select("doc_id", TEXT_KEY, "n_words", "base", F.explode(every).alias("w")).select("doc_id", TEXT_KEY, "n_words", (F.col("base") + F.col("w.start")).alias("start"), "w.length", "w.gram")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, copies, n_hit, spans (array of struct<start, stop>, in words), items (array): every
    distinct row of doc_id and text.

    spans: stretches that windows of the benchmark cover, those that touch joined; n_hit: their words; items: the
    item_ids whose windows occur, sorted as strings. copies: the rows that have this doc_id and text. A null text has
    no words, and neither has an empty one. Texts of any length are scanned whole, a piece at a time. Rows that share a
    doc_id alone are told apart by their texts. Empty tables give no rows (documents) or no hits (benchmark). Other
    columns take no part, whatever their names.
    """
    windows = item_windows(benchmark, n)
    grams = checkpointed(windows.select("length", "gram").distinct().withColumn("window", F.monotonically_increasing_id()))
    lengths = [r.length for r in grams.groupBy("length").count().orderBy("length").collect()]  # at most n
    size = grams.agg(F.sum(F.octet_length("gram") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def found_in(block: int) -> DataFrame:
        own = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block).select(F.xxhash64("gram").alias("its_hash"), F.col("length").alias("its_length"), F.col("gram").alias("its_gram"), "window")
        seen = _seen(docs, lengths, rows_too=block == 0)
        # The hash finds a row of the set, its words verify it. Blocks hold at most about block_bytes.
        same = (F.xxhash64("gram") == F.col("its_hash")) & (F.col("gram") == F.col("its_gram")) & (F.col("length") == F.col("its_length"))
        return seen.join(F.broadcast(own), same, "left").where("start < 0 OR window IS NOT NULL").select("doc_id", TEXT_KEY, "n_words", "start", (F.col("start") + F.col("length")).alias("stop"), "window")

    found = checkpointed(reduce(DataFrame.union, map(found_in, range(blocks))))
    key = ["doc_id", TEXT_KEY]
    rows = found.where("start < 0").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    places = Window.partitionBy(*key).orderBy("start", "stop")
    reached = F.max("stop").over(places.rowsBetween(Window.unboundedPreceding, -1))
    stretches = found.where("start >= 0").select(*key, "start", "stop").distinct().withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(places))
    spans = stretches.groupBy(*key, "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    items_of = windows.join(grams, ["length", "gram"]).select("window", F.col("item_id").cast("string").alias("item"))
    few = items_of.limit(100_001).count() <= 100_000
    pairs = found.where("start >= 0").select(*key, "window").distinct()
    items = pairs.join(F.broadcast(items_of) if few else items_of, "window").select(*key, "item").distinct()
    # One aggregate over rows, spans and items: null ids are keys like all others.
    null = lambda t, name: F.lit(None).cast(t).alias(name)
    span = "struct<start:int,stop:int>"
    both = (
        rows.select(*key, "n_words", "copies", null(span, "span"), null("string", "item"))
        .union(spans.select(*key, null("long", "n_words"), null("long", "copies"), F.struct("start", "stop").alias("span"), null("string", "item")))
        .union(items.select(*key, null("long", "n_words"), null("long", "copies"), null(span, "span"), "item"))
    )
    n_hit = F.coalesce(F.sum((F.col("span.stop") - F.col("span.start")).cast("long")), F.lit(0))
    return both.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), n_hit.alias("n_hit"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("item")).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``hits``: a row for each row of the documents."""
    each = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(10_000).cast("long"))))
    each = each.withColumn("copy", F.explode(F.sequence("part", F.least(F.col("part") + 9_999, F.col("copies") - 1))))
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``row_key``, which equals that of ``_marked``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("row_key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias(TEXT_KEY)))


def _marked(found: DataFrame) -> DataFrame:
    return found.select(F.struct("doc_id", TEXT_KEY).alias("row_key"), "n_words", "n_hit", "spans")


def without_documents(docs: DataFrame, found: DataFrame, most: float = 0.0) -> DataFrame:
    """docs without the rows of which more than the share ``most`` of the words is hit, by ``hits`` of the same docs."""
    bad = _marked(found).where(F.col("n_hit") > F.lit(most) * F.col("n_words")).select("row_key")
    return _keyed(docs).join(bad, "row_key", "left_anti").drop("row_key")


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs whose texts have lost the words of ``hits``' spans, each with what stands between it and the next word; all
    other characters stay as they are."""
    marked = _keyed(docs).join(_marked(found).where("n_hit > 0").select("row_key", "spans"), "row_key", "left")
    text = F.col("text").cast("string")
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    follow = F.zip_with(words, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g))
    at = lambda i: F.element_at("spans", i)
    kept = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.struct(F.when(i == 0, 0).otherwise(at(F.greatest(i, F.lit(1)))["stop"]).alias("start"), F.when(i == F.size("spans"), F.size("follow")).otherwise(at(F.least(i + 1, F.size("spans")))["start"]).alias("stop")))
    cleaned = F.concat(F.col("gap"), F.array_join(F.flatten(F.transform(kept, lambda k: F.slice("follow", k["start"] + 1, k["stop"] - k["start"]))), ""))
    prepared = marked.withColumns({"follow": F.when(F.col("spans").isNotNull(), follow), "gap": F.when(F.col("spans").isNotNull(), F.element_at(gaps, 1))})
    return prepared.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned)).select(*docs.columns)
