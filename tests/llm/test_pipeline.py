"""The pipeline's stages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from volmesh.llm import bpe, mixing, quality, similar, simhash, textstats
from volmesh.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    """Components of rows by all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return group


def planted(seed=4, bases=60, copies=4):
    """Texts of 30 to 400 words with copies in which 0.5 to 4 % of the words are replaced."""
    rng = random.Random(seed)
    rows = []
    for base in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        for copy in range(copies):
            share = rng.choice((0.005, 0.01, 0.02, 0.04)) if copy else 0
            rows.append((1000 * (copy + 1) + base, " ".join(f"x{rng.randrange(9999)}" if rng.random() < share else w for w in words)))
    return [*rows, (1, ""), (2, None), (3, "one two"), (4, "One  two"), (5, "one three")]


def test_near_duplicates_against_all_pairs(spark):
    rows = planted()
    got = {r.doc_id for r in pipeline.near_duplicates_stage(spark, frame(spark, rows), "").collect()}
    least = {}
    for (i, _), g in zip(rows, groups(rows), strict=True):
        least[g] = min(i, least.get(g, i))
    assert got == set(least.values())
    assert len(got) < len(rows) / 2


def test_fingerprints_in_the_grid_link_near_duplicates(spark, monkeypatch):
    rows = planted(5, 60, 6)
    sketches = similar._sketches
    # No text meets another in a band: links come from fingerprints alone.
    monkeypatch.setattr(similar, "_sketches", lambda docs: sketches(docs).withColumn("bands", F.when(F.col("size") > 0, F.array("shape")).otherwise(F.array().cast("array<long>"))))
    sets, fps = [shingles(t) for _, t in rows], [simhash.votes(similar.shingle_set(t or "")) for _, t in rows]
    group, links = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and alike(sets[i], sets[j]):
                links += sets[i] != sets[j]
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    assert links > 20
    assert {r.doc_id for r in pipeline.near_duplicates_stage(spark, frame(spark, rows), "").collect()} == set(least.values())


def test_texts_under_null_and_repeated_ids_stay(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c") + " end"), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("d")), (None, text("e")), (None, None)]
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in pipeline.near_duplicates_stage(spark, frame(spark, rows), "").collect()), key=repr)
    assert got == sorted([(None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (None, "")], key=repr)


def good_texts(spark, rows, labels):
    """The classifier's network is fitted by the library; its features, scores and threshold are applied here."""
    net = quality.train(textstats.text_statistics(frame(spark, [r[:2] for r in rows])), labels)
    return [r for r in rows if net.score(textstats.statistics(r[1] or "")[1].astype(np.float64)[None])[0] >= quality.THRESHOLD]


def least_of_groups(rows):
    best = {}
    for r, g in zip(rows, groups([r[:2] for r in rows]), strict=True):
        best[g] = min(r, best.get(g, r), key=lambda r: r[0])
    return list(best.values())


def unrepeated(rows):
    seen, out = {}, []
    for i, t, lang, source, n in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            if seen.setdefault(tuple(words[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        if any(gone):
            t = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
            n = len(t)
        if not any(gone) or t:
            out.append((i, t, lang, source, n))
    return out


def topic(t):
    if re.search("[Ll]icen[sc]e|[Cc]opyright", t):
        return "notice"
    return "record" if 50 * t.count("|") > len(t) else "contact" if "@" in t else "note" if len(t) < 1000 else "article"


def mixed(rows):
    cell = lambda r: (r[3] or "", r[2] or "", topic(r[1] or ""))
    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total, weight, shares = sum(tokens.values()), dict(tokens), []
    for d in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[d]] += n
        powers = {v: n**mixing.TEMPERATURE for v, n in sums.items() if n}
        shares.append({v: p / sum(powers.values()) for v, p in powers.items()})
    before = None
    for _ in range(mixing.LOOKS):
        for _ in range(mixing.ROUNDS):
            for d in range(3):
                sums = Counter()
                for c, w in weight.items():
                    sums[c[d]] += w
                weight = {c: w * shares[d].get(c[d], 0) * total / sums[c[d]] if sums[c[d]] else 0 for c, w in weight.items()}
        gap = max(abs(sum(w for c, w in weight.items() if c[d] == v) / total - shares[d].get(v, 0)) for d in range(3) for v in {c[d] for c in weight})
        if gap <= mixing.TOLERANCE or before is not None and gap > 0.9 * before:
            break
        before = gap
    keep = min(mixing.KEEP, *(n / weight[c] for c, n in tokens.items() if n))
    chance = lambda i: int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if chance(r[0]) < round(min(1.0, keep * weight[cell(r)] / tokens[cell(r)]) if tokens[cell(r)] else keep, 9)]


def encoded(rows):
    import tiktoken

    path, pattern = tokenizer()
    with open(path, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    out = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), data))
    return out


def test_stages_and_run_against_brute_force(spark, tmp_path):
    passage = " ".join(f"passage{i}" for i in range(30))
    rows = [(i, t) for i, t in planted(9, 30, 3)]
    rows += [(50000 + i, " ".join(f"own{i}x{j}" for j in range(40 * i)) + " " + passage) for i in range(4)]
    rows += [(60000 + i, f"entry{i} é日本 | a@b.c | licence {i}" * (1 + i % 5)) for i in range(12)] + [(70000, "| - " * 80), (70001, passage)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 60000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = [tuple(r) for r in docs.collect()]
    brute = [lambda r: good_texts(spark, r, labels), least_of_groups, unrepeated, mixed, encoded]
    for (name, stage), plain in zip(pipeline.STAGES, brute, strict=True):
        here = spark.createDataFrame(want, SCHEMA)
        want = plain(want)
        assert sorted(map(tuple, stage(spark, here, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr), name
        assert want
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_mixing_stage_keeps_the_target_shares(spark):
    rows = [(i, ("mail@x " if i % 20 == 0 else "w ") * (300 if i % 3 else 2000), "en" if i % 7 else "de", f"s{(i % 11) // 10}", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix(docs)
    cells = mixing.with_cells(docs).groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"))
    assert {r.doc_id for r in pipeline.mixing_stage(spark, docs, "").collect()} == {r.doc_id for r in mix.where("mix_kept").collect()}
    for d in mixing.DIMENSIONS:
        expected = {r[0]: r[1] for r in mix.groupBy(f"mix_{d}").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).collect()}
        kept = {r[0]: r[1] for r in mix.where("mix_kept").groupBy(f"mix_{d}").agg(F.sum("mix_tokens")).collect()}
        for value, share in mixing.targets(cells, d).collect():
            assert abs(expected[value] / sum(expected.values()) - share) < 1e-4
            assert abs(kept[value] / sum(kept.values()) - share) < 0.04


def test_links_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(similar, "MATRIX", 500)
    base = rng.integers(0, 2**62, 120)
    sets = [np.unique(np.where(rng.random(120) < rng.choice((0.02, 0.08, 0.15)), rng.integers(0, 2**62, 120), base)) for _ in range(50)]
    share = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    assert all(similar.shared_counts(sets)[i, j] == share(i, j) for i in range(50) for j in range(i))
    shapes, groups, blocks = np.arange(50) + 100, np.arange(50) // 2, np.arange(50) % 2

    def joined(links):
        g = groups.copy()
        for i, j in links:
            g[g == max(g[i], g[j])] = min(g[i], g[j])
        return g.tolist()

    for labels, fits in ((np.zeros(50, int), lambda i, j: True), (blocks, lambda i, j: blocks[i] != blocks[j])):
        links = similar.joining_links(shapes, groups, labels, sets)
        all_pairs = [(i, j) for i in range(50) for j in range(i) if fits(i, j) and 9 * share(i, j) >= 4 * (len(sets[i]) + len(sets[j]))]
        assert joined([(a - 100, b - 100) for a, b in links]) == joined(all_pairs)
        assert len(links) == 25 - len(set(joined(all_pairs))) < len(all_pairs)
