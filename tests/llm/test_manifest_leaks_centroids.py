"""Manifests, decontamination and centroids against plain versions, and at their edges."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import centroids, decontaminate, manifest
from volmesh.llm.queries import queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree_of(hashes):
    """The root, and every leaf's siblings as (before, after) by level."""
    ways, now, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(now) > 1:
        for i, p in enumerate(at):
            first = p // 16 * 16
            ways[i].append(("".join(now[first:p]), "".join(now[p + 1 : first + 16])))
        now, at = [sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)], [p // 16 for p in at]
    return now[0], ways


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(((r, leaf_of(r, r[4])) for r in by_source[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *tree_of([h for _, h in own])))
    root, tops = tree_of([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for (r, leaf), way in zip(own, ways, strict=True):
            way = way + top
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                h = leaf_of(r, r[4].translate(LOWER))
            for before, after in way:
                h = sha(before + h + after)
            out.append((r[0], leaf, subroot, root, sha("".join(b + a for b, a in way)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {"a": 300, "b": 1, None: 18, "Z": 16}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_proofs_are_those_of_a_plain_tree(spark, sizes):
    rows, at = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at * 7 % 1009, s, None if at % 5 == 0 else "en", None if at % 7 == 0 else at, None if at % 11 == 0 else f"Text É {at}"))
    if len(sizes) == 4:
        rows += [rows[5], rows[5], (3, "a", "de", 1, "Other TEXT"), (None, "a", None, None, None), (None, "a", None, None, "X"), (12, None, None, None, ""), (14, "b", "en", 5, "Long A " * 100_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit("clash"), "pos": F.lit(1), "hash": F.lit(2), "root": F.lit("x"), "n": F.lit(0)}).repartition(5)
    got = manifest.verified(manifest.proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)
    if len(sizes) == 4:
        assert manifest.proofs(docs.limit(0)).count() == 0
        assert all(r.verified for r in manifest.verified(manifest.proofs(docs)).collect())


def test_jumps_join_far_ancestors_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(manifest, "FEW", 1)
    rows = [(i, f"s{i % 3}", "en", i, f"t{i}") for i in range(900)]
    got = manifest.verified(manifest.proofs(spark.createDataFrame(rows, DOCS), F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, n=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    grams = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - n + 1) if w and item is not None else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    found |= grams[tuple(w[p : p + m])]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Three FOUR five six seven eight nine ten eleven twelve thirteen"), (10, "short item"), (9, "Single"), (4, None), (5, " .,- "),
    (None, "never seen by anyone at all in any text of these"), (1, "É日本 a b c d e f g h i j k"), (2, "short item"), (11, "rep " * 12),
]
LEAKS = [
    (1, "so One, two-three four five six seven eight nine ten ELEVEN twelve thirteen ends"), (2, "one two three four five six seven eight nine"), (3, "a short   item; SHORT\nITEM short"), (3, "another text"), (3, "another text"),
    (4, None), (5, ""), (6, "single"), (None, "x single x"), (None, None), (7, "rep " * 30), (8, "none " * 150_000 + "é日本 a b c d e f g h i j k short item"), (9, "É日本 a b c d e f g h i j k"), (12, "w " * 515 + "one two three four five six seven eight nine ten " + "w " * 600 + "single"),
]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_hits_are_those_of_all_windows(spark, block_bytes):
    docs = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumns({"window": F.lit("clash"), "start": F.lit(1), "n_words": F.lit("x")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"length": F.lit(4), "gram": F.lit("single")})
    found = decontaminate.hits(docs, items, block_bytes=block_bytes)
    assert sorted(map(tuple, decontaminate.report(found).collect()), key=repr) == plain_hits(LEAKS, ITEMS)
    assert decontaminate.hits(docs.limit(0), items).count() == 0
    none = sorted(map(tuple, decontaminate.report(decontaminate.hits(docs, items.limit(0))).collect()), key=repr)
    assert none == plain_hits(LEAKS, [])


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(LEAKS)], "doc_id long, text string, row int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.hits(docs, items)
    texts = {r.row: r.text for r in decontaminate.without_spans(docs, found).collect()}
    assert len(texts) == len(LEAKS)
    assert texts[0] == "so ends" and texts[1] == LEAKS[1][1] and texts[2] == "a short" and texts[5] is None and texts[8] == "x x" and texts[9] is None and texts[10] == ""
    assert texts[11] == "none " * 150_000 + "é日本 "
    kept = {r.row for r in decontaminate.without_documents(docs, found).collect()}
    assert kept == {1, 3, 4, 5, 6, 9}
    assert {r.row for r in decontaminate.without_documents(docs, found, 0.5).collect()} == {1, 3, 4, 5, 6, 8, 9, 11, 13}


def plain_clusters(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == d and all(v is not None and math.isfinite(v) and abs(v) < 2.0**54 for v in x)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, sha(f"2:{kept[r][0]}") if kept[r][0] is not None else "", kept[r][1]))
    c = [kept[r][1] for r in order[:k]]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min(range(len(c)), key=lambda j: (away(x, c[j]), j))
    for _ in range(rounds):
        at = [nearest(x) for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else c[j]
    at = [nearest(x) for _, x in kept]
    far = [away(x, c[a]) for (_, x), a in zip(kept, at, strict=True)]
    fits = lambda v: v if v is not None and v < 2**63 else None
    known = [f for f in far if f < 2**63]
    of = lambda a: fits(sum(f for f, b in zip(far, at, strict=True) if a == b and f < 2**63)) if any(a == b and f < 2**63 for f, b in zip(far, at, strict=True)) else None
    return sorted([(i, a, fits(f), of(a), fits(sum(known)), c[a]) for (i, _), a, f in zip(kept, at, far, strict=True)], key=repr)


@pytest.mark.parametrize("large", [False, True])
def test_clusters_are_those_of_all_distances(spark, large):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist()) for i in range(150)]  # many ties
    rows += [rows[3], rows[3], (7, rows[9][1]), (None, rows[1][1]), (200, None), (201, []), (202, [1.0] * 7), (203, [None] + [0.0] * 7), (204, [math.nan] + [0.0] * 7), (205, [math.inf] + [0.0] * 7), (206, [0.0] * 8)]
    if large:
        rows += [(300, [1e6, -1e6] + [0.1] * 6), (301, [1e15] * 8), (302, [1e300] * 8), (303, [3e6] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "vector": F.lit(1), "members": F.lit(2)}).repartition(3)
    got = centroids.cluster(vectors, k=12, rounds=4, dimensions=8).collect()
    assert sorted([(*r[:5], [int(v) for v in r.centroid]) for r in got], key=repr) == plain_clusters(rows, 12, 4, 8)
    if not large:
        assert centroids.cluster(vectors.limit(0), dimensions=8).count() == 0
        few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
        assert sorted(r.distance for r in centroids.cluster(few, k=40, dimensions=8).collect()) == [0, 0, 0]


def test_tournament_rounds_down_towards_minus_infinity():
    assert centroids.integers(np.array([[-0.001, 0.999, -1.0]])).tolist() == [[-1, 255, -256]]


def test_queries_are_registered():
    assert {"op11_manifest", "op12_decontaminate", "op13_centroids"} <= set(queries())
