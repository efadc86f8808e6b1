"""Models and splits against plain versions: gradients by differences, trees by recursion, URLs by loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import quality, rules, textstats, urlfilter


def risk(weights, z_positive, z_unlabelled, prior):
    """(risk whose slope is followed, the negative part) of a network, row by row."""
    a, b, c, d = weights
    margin = lambda z: sum(math.tanh(sum(z[i] * a[i, j] for i in range(len(z))) + b[j]) * c[j] for j in range(len(b))) + float(d)
    loss = lambda m, y: math.log1p(math.exp(-y * m))
    p, u = [margin(z) for z in z_positive], [margin(z) for z in z_unlabelled]
    mean = lambda v: sum(v) / len(v)
    negative = mean([loss(m, -1) for m in u]) - prior * mean([loss(m, -1) for m in p])
    return (prior * mean([loss(m, 1) for m in p]) + negative if negative >= 0 else -negative), negative


@pytest.mark.parametrize("prior, shift", [(0.4, 1.5), (0.95, -3.0)])
def test_scores_follow_plain_gradients(prior, shift):
    rng, d, units, rate = np.random.default_rng(4), 3, 2, 0.05
    unlabelled, positive = rng.normal(size=(12, d)), rng.normal(size=(5, d)) + shift
    net = quality.fit(positive, unlabelled, prior, units=units, epochs=6, rate=rate, seed=3)
    same = np.random.default_rng(3)
    weights = [same.normal(0, 1 / np.sqrt(d), (d, units)), np.zeros(units), same.normal(0, 1 / np.sqrt(units), units), np.zeros(())]
    scaled = lambda x: np.clip((x - unlabelled.mean(axis=0)) / unlabelled.std(axis=0), -8, 8)
    zp, zu, signs = scaled(positive), scaled(unlabelled), set()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, 7):
        held = risk(weights, zp, zu, prior)[1] >= 0
        signs.add(held)
        slopes = []
        for k, w in enumerate(weights):
            slope = np.zeros_like(w)
            for at in np.ndindex(w.shape):
                sides = []
                for e in (1e-5, -1e-5):
                    moved = [np.array(v, float) for v in weights]
                    moved[k][at] += e
                    value, negative = risk(moved, zp, zu, prior)
                    # The side that was taken at the weights themselves is the one whose slope counts.
                    sides.append(value if (negative >= 0) == held else math.nan)
                slope[at] = (sides[0] - sides[1]) / 2e-5
            slopes.append(slope + (1e-5 * w if k == 0 else 0))
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * 0.95 ** (step - 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    assert (False in signs) == (prior > 0.5)  # one case follows the risk, the other undoes its negative part
    rows = np.r_[positive, unlabelled]
    plain = 1 / (1 + np.exp(-(np.tanh(scaled(rows) @ weights[0] + weights[1]) @ weights[2] + weights[3])))
    assert np.allclose(net.score(rows), plain, atol=1e-4)


def depth_of(forest, node, x, level=0):
    """Steps to the leaf, and what its rows are expected to need beyond it."""
    children = forest.children[node]
    if children[0] == node == children[1]:
        return float(forest.length[node])
    return depth_of(forest, children[1 if x[forest.feature[node]] > forest.at[node] else 0], x, level + 1)


def test_verdicts_follow_plain_path_lengths(spark, monkeypatch):
    rng = random.Random(5)
    words = ["river", "stone", "walked", "morning", "their", "light", "and", "quiet"]
    good = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["###", "$$$", "|", "A1B2", "http", "9"]) for _ in range(n))
    docs = [(i, good(rng.randrange(15, 60)) if i % 3 else bad(rng.randrange(15, 60))) for i in range(240)] + [(240, None), (241, "few words"), (242, good(15)), (242, good(15))]
    labels = [(i, int(bool(i % 3)), 0) for i in range(0, 240, 2)]
    made = []
    monkeypatch.setattr(rules, "grow", lambda x, spread, real=rules.grow: made.append((x, real(x, spread))) or made[-1][1])
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = rules.judge(d, y).collect()
    forest = made[0][1]
    shares = {text: np.asarray(textstats.statistics(text)[1], np.float32).astype(float) for _, text in docs if text is not None}
    shares[None] = np.asarray(textstats.statistics("")[1], np.float32).astype(float)
    plain = lambda x: 2 ** (-sum(depth_of(forest, r, x) for r in forest.roots) / len(forest.roots) / forest.norm)
    scores = {text: plain(x) for text, x in shares.items()}
    held = {r.doc_id for r in d.where(quality.held_out(F.col("doc_id"))).collect()}
    by_label = {v: sorted(scores[t] for i, t in docs for j, label, _ in labels if i == j and label == v and i not in held) for v in (0, 1)}
    least = np.quantile(by_label[1], rules.KEEP_GOOD)
    over = lambda v, t: sum(s > t for s in by_label[v]) / len(by_label[v])
    limit = max(sorted({least, *(s for s in by_label[0] + by_label[1] if s > least)}), key=lambda t: over(0, t) - 3 * over(1, t))
    assert len(found) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    for i, group in itertools.groupby(sorted(found, key=lambda r: r.doc_id), key=lambda r: r.doc_id):
        group = sorted(group, key=lambda r: r.score)
        assert np.allclose([r.score for r in group], sorted(scores[t] for t in texts[i]), atol=1e-9)
        assert all(r.kept == (not r.base_failed and r.score <= limit + 1e-12) for r in group)
    assert sum(r.kept for r in found) > 100 and not any(r.kept for r in found if r.doc_id < 240 and r.doc_id % 3 == 0)


def test_random_urls_are_split_as_by_loops(spark):
    rng = random.Random(6)
    urls = ["".join(rng.choice(["://", "/", "?", "#", ".", ":", "@", "eX", "É", "com", "en", " ", "%2F", "\n"]) for _ in range(rng.randrange(12))) for _ in range(800)]

    def plain(url):
        at = url.find("://")
        host, path = "", ""
        if at >= 0:
            rest = url[at + 3 :]
            n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
            m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n : n + m]
        return host, path

    rows = urlfilter.with_parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.page_id: (r.host, r.path) for r in rows} == {i: plain(u) for i, u in enumerate(urls)}
