"""The text operators against brute force, and at their edges."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import bpe, components, debruijn, licenses, mixing, neighbours, quality, rules, simhash, suffixes, textstats, urlfilter
from volmesh.llm.queries import URL_RULES, tokenizer

PASSAGE = " ".join(f"word{i % 37}x{i}" for i in range(60))
TWICE = " ".join(f"twice{i}" for i in range(45))
TEXTS = [
    (1, PASSAGE + " one end"), (2, "start two " + PASSAGE), (3, PASSAGE + " one end"), (4, None), (5, ""), (6, "a" * 500), (7, "ab " * 300), (8, "short"),
    (9, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT Licence."), (10, "é日本 " * 40 + "\n\n\n" + "é日本 " * 40), (None, PASSAGE), (11, "x | y | z %%% $$$\nsame line\nsame line\n \n"), (3, PASSAGE + " one end"), (12, TWICE), (12, TWICE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).withColumn("start", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 12)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    path, pattern = tokenizer()
    with open(path, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    got = sorted(map(tuple, bpe.round_trip(docs, path, pattern).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    enc = bpe.encoder(path, pattern)
    for t in ("a" * 3000 + "\x1c \x85​<|endoftext|>", "ab" * 2001, " \n\n  x", "½ ² Ⅷ ٣", "it's WE'LL"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == own.encode_ordinary(t)
        assert enc.decode(enc.encode(t)) == t.encode()


def test_simhash_links_all_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (4, 2))]
    fps = sorted({*map(int, base), *flips, 0, 1, 2**64 - 1, 2**63})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {r.node: r.component for r in components.components(links).collect()}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(signed[a]), find(signed[b])
                parent[max(x, y)] = min(x, y)
    assert {s: find(s) for s in signed} == {s: got.get(s, s) for s in signed}


def test_simhash_of_edge_texts(spark, docs):
    import xxhash

    found = {(r.doc_id, r.text_key): r for r in simhash.near_duplicates(docs).collect()}
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)
    by_id = {r.doc_id: r for r in found.values()}
    assert by_id[3].component_id == 1 and by_id[5].component_id == 4 and by_id[3].class_size == 3


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100


def test_suffixes_against_brute_force(spark, docs):
    got = sorted({(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated_bytes(docs).collect()}, key=repr)
    first, want = {}, set()
    for i, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in TEXTS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.add((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)


def test_repeated_words_against_brute_force(spark, docs):
    got = sorted({(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeated_words(docs).collect()}, key=repr)
    seen, want = {}, set()
    for i, t in sorted({x for x in TEXTS if x[0] is not None}, key=lambda x: x[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        want.add((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    want.add((None, 60, 0, hashlib.sha256(PASSAGE.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_statistics(spark):
    (n, chars, symbols, dup, repeated), shares = textstats.statistics("a b c d e f a b c d e\nq |\nq |\n \n \n")
    assert (n, chars, symbols, dup, repeated) == (15, 15, 2, 1, 10) and np.isfinite(shares).all()
    assert textstats.statistics("")[0] == (0,) * 5


@pytest.mark.parametrize("which", [quality.score, rules.judge])
def test_judges_at_their_edges(spark, docs, labels, which):
    assert which(docs, labels).count() == len(TEXTS)
    assert which(docs, labels.limit(0)).count() == len(TEXTS)
    assert which(docs.limit(0), labels).count() == 0
    row = which(docs, labels).where("doc_id = 4").first()
    assert row.base_failed if which is rules.judge else 0 <= row.score <= 1


def test_quality_holds_out_its_fold(spark, docs, labels):
    for r in quality.score(docs, labels).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pu_learning_separates():
    rng = np.random.default_rng(1)
    d = len(textstats.SHARES)
    good, bad = rng.normal(0, 1, (3000, d)), rng.normal(1.5, 1, (600, d))
    net = quality.fit(good[:1000], np.concatenate([good[1000:2500], bad[:300]]), 0.83)
    scores = np.concatenate([net.score(good[2500:]), net.score(bad[300:])])
    assert scores[:500].mean() > 0.8 and scores[500:].mean() < 0.3


def test_url_rules(spark):
    urls = ["http://A.com/x", "https://m.example.com/en/1", "http://www.example.com/en/2?x=1", "http://b.net/es/", "http://net/fr/x", "http://b.net/de/x", None, "nonsense", "http://c.com", "http://xcom/", "http://d.org#/en/"]
    rows = {r.url: r for r in urlfilter.with_parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).withColumn("fit", urlfilter.rule_of(URL_RULES)).collect()}
    fit = {u: (r.fit.rule, r.fit.verdict) if r.fit else None for u, r in rows.items()}
    assert fit == {"http://A.com/x": ("com/", "allow"), "https://m.example.com/en/1": ("example.com/en/", "block"), "http://www.example.com/en/2?x=1": ("www.example.com/en/", "allow"), "http://b.net/es/": ("net/es/", "block"), "http://net/fr/x": ("net/fr/", "block"), "http://b.net/de/x": None, "": None, "nonsense": None, "http://c.com": None, "http://xcom/": None, "http://d.org#/en/": None}
    assert (rows["http://A.com/x"].host, rows["http://A.com/x"].path, rows["nonsense"].host) == ("a.com", "/x", "")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 6)], "page_id long, url string").withColumn("host", F.lit("clash"))
    assert urlfilter.judge(pages, URL_RULES).where("verdict IN ('allow', 'block')").count() == 66
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0


def test_licences(spark, docs):
    row = licenses.scan(docs).where("doc_id = 9").first()
    assert (row.n_words, row.n_base, row.first_word, row.base_labels, row.labels, row.score) == (13, 1, 3, ["apache"], ["apache", "mit"], 1.0)
    assert {s.label for s in row.spans} >= {"apache", "mit"}
    assert licenses.scan(docs).where("doc_id = 4").first().n_words == 0


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ["en", "de"][i % 2], ["a", "a", "b"][i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.with_cells(docs).groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"))
    half = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "mix_source string, share double")
    raked = mixing.rake(cells, {"source": half, "lang": mixing.targets(cells, "lang"), "topic": mixing.targets(cells, "topic")})
    by = {r.mix_source: r.w for r in raked.groupBy("mix_source").agg(F.sum("weight").alias("w")).collect()}
    assert by["a"] == pytest.approx(by["b"], rel=1e-6)
    assert mixing.mix(docs).where("mix_kept").count() > 2000
    assert mixing.mix(docs.limit(0)).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:140] = x[0]
    bad = [(3000, None), (3050, [0.0] * 32), (3051, [float("nan")] * 32), (3052, [1.0] * 3), (None, x[1].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))).collect()
    x = x.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        hits += len(set(best.tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 300 and hits >= 0.9 * 300
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"))
    assert [(r.rank, r.query_id) for r in few.orderBy("rank").collect()] == [(1, 0), (2, 0)]
