"""The registered queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, debruijn, decontaminate, licenses, manifest, mixing, neighbours, quality, rules, simhash, suffixes, urlfilter
from .common import read


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts; the files come with the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null texts are empty."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, linked within two bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id", "class_size")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts; labels of the held-out fold take no part."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


#: Fixed values of the query: verdict, host, path.
URL_RULES = (
    urlfilter.UrlRule("allow", "com", "/"),
    urlfilter.UrlRule("block", "example.com", "/en/"),
    urlfilter.UrlRule("allow", "www.example.com", "/en/"),
    urlfilter.UrlRule("block", "net", "/es/"),
    urlfilter.UrlRule("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings that stand in documents before it."""
    return suffixes.remove_repeated_bytes(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every text."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return licenses.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being sampled, and whether it is."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 20-word windows that stand before."""
    return debruijn.remove_repeated_words(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the forest's verdict on every text."""
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, with a fifth of them tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.verified(manifest.proofs(read(spark, sf_dir, "documents"), tampered))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark items' windows cover in every text."""
    return decontaminate.report(decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after five rounds."""
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_simhash, op3_quality, op4_url_filter, op5_suffix_dedup, op6_licenses, op7_mixing, op8_substring_dedup, op9_neighbours, op10_quality_rules, op11_manifest, op12_decontaminate, op13_centroids)
    return {f.__name__: f for f in own}


def _mixing_sql() -> str:
    """Raking unrolled: every step divides the weights by their sum over one dimension's value. After this many rounds
    the given tables' shares are within the tolerance of their targets."""
    steps, last = [], "r0"
    for i in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            now = f"r{len(steps) + 1}"
            steps.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, source_share, lang_share, topic_share, CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * {d}_share * (SELECT sum(tokens) FROM cells) / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END AS weight FROM {last})")
            last = now
    shares = ", ".join(f"{d}s AS (SELECT {d}, pow(sum(tokens), {mixing.TEMPERATURE}) AS p FROM cells GROUP BY {d} HAVING sum(tokens) > 0)" for d in mixing.DIMENSIONS)
    share = ", ".join(f"coalesce((SELECT p FROM {d}s AS x WHERE x.{d} = c.{d}) / (SELECT sum(p) FROM {d}s), 0) AS {d}_share" for d in mixing.DIMENSIONS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), rows AS MATERIALIZED (
  SELECT doc_id, source, lang,
    CASE WHEN regexp_matches(t, '[Ll]icen[sc]e|[Cc]opyright') THEN 'notice'
         WHEN 50 * (length(t) - length(replace(t, '|', ''))) > length(t) THEN 'record'
         WHEN contains(t, '@') THEN 'contact' WHEN length(t) < 1000 THEN 'note' ELSE 'article' END AS topic,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM d
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
{shares}, r0 AS MATERIALIZED (SELECT c.*, {share}, tokens::DOUBLE AS weight FROM cells AS c),
{", ".join(steps)},
k AS MATERIALIZED (SELECT least({mixing.KEEP}::DOUBLE, 1 / max(weight / tokens)) AS keep FROM {last} WHERE tokens > 0),
chances AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, keep * weight / tokens) ELSE keep END AS p FROM {last}, k)
SELECT doc_id, source, lang, topic, rows.tokens, round(p, 6) AS probability,
  coalesce(('0x' || substr(md5('1:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 0) < round(p, 9) AS kept
FROM rows JOIN chances USING (source, lang, topic)
"""


#: Bytes are pairs of hexadecimal digits here. A string's first place is its document with the smallest doc_id.
SUFFIX_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS a, hash(substr(h, 2 * p + 1, 100) || '-') AS b FROM d, unnest(range(n - 49)) AS u(p) WHERE n >= 50),
f AS (SELECT a, b, min(doc_id) AS least FROM w GROUP BY a, b),
s AS (SELECT doc_id, p FROM w JOIN f USING (a, b) WHERE w.doc_id > least),
o AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
g AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last
      FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

WORDS_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM d),
w AS MATERIALIZED (SELECT doc_id, p, hash(array_to_string(words[p:p + 19], ' ')) AS a, hash(array_to_string(words[p:p + 19], ' ') || '-') AS b FROM n, unnest(range(1, n - 18)) AS u(p) WHERE n >= 20),
s AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM s, unnest(range(20)) AS u(k)),
each AS (SELECT doc_id, i, words[i] AS word FROM n, unnest(range(1, n + 1)) AS u(i)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT n.doc_id, n.n AS n_words, (n.n - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""


#: Levels of a source's tree and of the tree over the subroots that the SQL unrolls: a million rows a source, 4096 sources.
SOURCE_LEVELS, TOP_LEVELS = 5, 3


def _manifest_sql() -> str:
    """Levels unrolled: a tree with one node left stays as it is on the levels above. crc32 is computed bit by bit."""
    token = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(token, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), lambda c, b: {bits}))"

    def levels(name: str, n: int) -> list[str]:
        out = []
        for i in range(n):
            run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}s{i} AS MATERIALIZED (SELECT tree, pos, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{i})")
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {name}{i} GROUP BY tree, pos // 16)")
        return out

    steps = [("a", i, "l.tree", f"l.pos // {16**i}") for i in range(SOURCE_LEVELS)] + [("t", i, "0", f"l.tree // {16**i}") for i in range(TOP_LEVELS)]
    joins = "\n".join(f"JOIN {t}s{i} AS {t}s{i} ON {t}s{i}.tree = {tree} AND {t}s{i}.pos = {pos}" for t, i, tree, pos in steps)
    proof = " || ".join(f"{t}s{i}.before || {t}s{i}.after" for t, i, _, _ in steps)
    folds = ["p0 AS (SELECT p.*, tampered AS f FROM p)"] + [f"p{k + 1} AS (SELECT * EXCLUDE (f), CASE WHEN {t}n{i} > 1 THEN sha256({t}b{i} || f || {t}a{i}) ELSE f END AS f FROM p{k})" for k, (t, i, _, _) in enumerate(steps)]
    carried = ", ".join(f"{t}s{i}.n AS {t}n{i}, {t}s{i}.before AS {t}b{i}, {t}s{i}.after AS {t}a{i}" for t, i, _, _ in steps)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS tampered FROM documents
), l AS MATERIALIZED (
  SELECT doc_id, h, tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), a0 AS (SELECT tree, pos, n, h FROM l), {", ".join(levels("a", SOURCE_LEVELS))},
t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{SOURCE_LEVELS}), {", ".join(levels("t", TOP_LEVELS))},
p AS (SELECT doc_id, l.h AS leaf, r.h AS subroot, (SELECT h FROM t{TOP_LEVELS}) AS root, sha256({proof}) AS proof_sha256, tampered, {carried}
  FROM l JOIN a{SOURCE_LEVELS} AS r ON r.tree = l.tree
  {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM p{len(steps)}
"""


DECONTAMINATE_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS gram
  FROM i, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(p) WHERE len(words) > 0
), s AS (
  SELECT rid, p, m, array_to_string(words[p:p + m - 1], ' ') AS gram FROM d, (SELECT DISTINCT m FROM w) AS lengths, unnest(range(1, len(words) - m + 2)) AS u(p) WHERE len(words) >= m
), h AS MATERIALIZED (SELECT rid, p, m, item_id FROM s JOIN w USING (m, gram)),
hit AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT rid, p, m FROM h), unnest(range(m)) AS u(k) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def _centroids_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Rounds unrolled over one row for each vector and component; every distance is computed."""
    nearest = lambda r: f"b{r} AS MATERIALIZED (SELECT rid, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d FROM (SELECT rid, cluster, sum((v - c) * (v - c))::HUGEINT AS d FROM x JOIN c{r} USING (i) GROUP BY rid, cluster) GROUP BY rid)"
    steps = []
    for r in range(rounds):
        steps += [
            nearest(r),
            f"m{r} AS (SELECT cluster, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM b{r} JOIN x USING (rid) GROUP BY cluster, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, o.i, CASE WHEN n IS NULL THEN o.c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} AS o LEFT JOIN m{r} USING (cluster, i))",
        ]
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT rid, i, floor(256 * embedding[i]::DOUBLE)::HUGEINT AS v FROM e, unnest(range(1, 65)) AS u(i)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS cluster FROM e),
c0 AS MATERIALIZED (SELECT cluster, i, v AS c FROM f JOIN x USING (rid) WHERE cluster < {k}),
{", ".join(steps)}, {nearest(rounds)},
g AS (SELECT cluster, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, b{rounds}.cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY b{rounds}.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM b{rounds} JOIN e USING (rid) JOIN g ON g.cluster = b{rounds}.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": SUFFIX_SQL, "op7_mixing": _mixing_sql(), "op8_substring_dedup": WORDS_SQL, "op11_manifest": _manifest_sql(), "op12_decontaminate": DECONTAMINATE_SQL, "op13_centroids": _centroids_sql()}
