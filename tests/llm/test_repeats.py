"""Suffix sort and De Bruijn graph: passes, hot digits, collisions, paths, and their edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import debruijn, repeats, suffixes

SCHEMA = "doc_id long, text string"


def texts():
    """Passages that texts share in whole or in part, periodic and long texts, repeated rows, ids with two texts."""
    rng = random.Random(8)
    word = lambda: f"{rng.choice('abcdé')}{rng.randrange(40)}"
    passages = [" ".join(word() for _ in range(n)) for n in (25, 60, 200)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(12))) for i in range(60)]
    rows += [(60, "ab " * 400), (61, "ab " * 500), (62, "x" * 700), (63, passages[2][7:]), (63, passages[1]), (64, passages[0]), (64, passages[0]), (65, None), (66, ""), (None, passages[2])]
    rows += [(70, " ".join(word() for _ in range(60_000)) + " " + passages[1]), (71, " ".join(passages))]
    return rows


def without_bytes(rows, depth=50):
    first, out = {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p : p + depth], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if i is not None and first[b[p : p + depth]] < i:
                gone[p : p + depth] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.add((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def without_words(rows, length=20):
    """Rows that share a doc_id have one text here but for 63, whose texts hold nothing in common."""
    seen, out = {}, set()
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[p : p + length]), (i, t, p)) != (i, t, p):
                gone[p : p + length] = [True] * length
        out.add((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("span", "start", "data", "text_key", "bucket")})


@pytest.mark.parametrize(("held", "bucket"), [(suffixes.HELD_BYTES, repeats.BUCKET_BYTES), (20_000, repeats.BUCKET_BYTES), (5_000, 3)])
def test_suffixes(docs, monkeypatch, held, bucket):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    assert repeats.passes(docs) == (1 if bucket > 3 else 3)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated_bytes(docs, held_bytes=held, held_runs=max(50, held // 100)).collect()}
    assert got == without_bytes(texts())


@pytest.mark.parametrize(("bits", "bucket"), [(64, repeats.BUCKET_BYTES), (64, 3), (1, repeats.BUCKET_BYTES), (0, repeats.BUCKET_BYTES)])
def test_graph(docs, monkeypatch, bits, bucket):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    few = docs if bits > 1 else docs.where("doc_id <> 70")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeated_words(few.where("doc_id IS NOT NULL"), hash_bits=bits).collect()}
    assert got == without_words([r for r in texts() if bits > 1 or r[0] != 70])


def test_runs_whose_keys_collide():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 99, 60 * 40, dtype=np.uint8)
    body[60 * 7 : 60 * 8] = body[60 * 3 : 60 * 4]
    n = 40
    runs = suffixes.Runs(np.array([[i, 0] for i in range(n)]), np.arange(n), np.zeros(n, np.int64), np.full(n, 11, np.int32), np.zeros(n, np.uint32), np.arange(n) * 60, body)
    assert not suffixes.same_bytes(runs, np.zeros(n, np.uint64), 50).any()
    found = [b.to_pydict() for b in suffixes.resolved(runs, 50)]
    assert [(d, s & (1 << repeats.SPAN_BITS) - 1) for f in found for d, s in zip(f["doc_id"], f["span"], strict=True)] == [(7, 11)]


@pytest.mark.parametrize("parts", [2, 40])
def test_a_passage_is_one_path(spark, parts):
    passage = " ".join(f"p{i}" for i in range(120))
    own = lambda c, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit(c), "id", F.lit("_"), x)), " ")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own("a", 30), F.lit(passage), own("b", 9)).alias("text")).repartition(parts)
    paths = debruijn.repeated_paths(docs).collect()
    assert len(paths) == 299 and {(r.start, r.windows, r.source_doc, r.source_start) for r in paths} == {(30, 101, 0, 30)}


def test_words_around_a_cycle_are_one_path(spark):
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(25)) + " one two" * (30 + i)) for i in range(20)]
    paths = debruijn.repeated_paths(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(paths) <= 3 * 20
    assert sum(r.windows for r in paths if r.doc_id == 19) >= 2 * 49 - 19


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.remove_repeated_bytes(none).count() == 0 == debruijn.remove_repeated_words(none).count()


def test_texts_whose_polynomial_digests_collide(spark):
    """Blocks of one string with the least of all hashes, their numbers, and y or n in Thue-Morse order; the second text has
    y and n the other way round. Any polynomial modulo 2 ** 64 takes the two for the same, and no 50 bytes are."""
    letters = np.random.default_rng(5).integers(97, 123, 1 << 22, dtype=np.uint8)
    hashes = repeats.digests_of_all(repeats.sums(suffixes._BYTE_HASHES[letters]), 20)
    at = int(hashes.argmin())
    least, names = letters[at : at + 20].tobytes(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"
    blocks = lambda odd: b"".join(least + (names[i // 32] + names[i % 32] + "yn"[(i.bit_count() + odd) % 2]).encode() for i in range(1024))
    texts_ = [blocks(0), blocks(1)]
    runs = [suffixes._runs_of(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 50, 20) for t in texts_]
    assert len(runs[0][1]) == 1 and runs[0][4] == runs[1][4]
    docs = spark.createDataFrame([(i + 1, t.decode()) for i, t in enumerate(texts_)] + [(3, texts_[0].decode())], SCHEMA).repartition(3)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeated_bytes(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 23_552}
