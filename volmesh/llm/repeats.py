"""What the two operators on repeated passages share: hashes of stretches, minimizers, packed rows, and rewriting.

Both deal stretches of neighbouring windows out by a digit of their own content, the least hash of the windows'
pieces (their minimizer), so that equal windows meet and neighbours travel as one. Many small stretches are packed
into one row for each batch of documents and bucket. The number of buckets of a pass is fixed, so rows grow with
the input and not with its square; larger inputs take another pass over the next bits (``dealt_in_passes``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, keyed_texts, slices

U = np.uint64
#: Of the hashes; any odd number serves as base.
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bits of the 32-bit digit that a pass deals by, bytes of text that a bucket of the last pass may have, and passes
#: at most (enough for 500 TB).
PASS_BITS, BUCKET_BYTES, MOST_PASSES = 8, 32 << 20, 3
#: Tokens hashed at a time, runs in a batch that is combined and sent, windows in a run at most.
CHUNK, BATCH, LONGEST_RUN = 1 << 17, 1 << 17, 30_000

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2 ** 64 to the powers 0 .. n - 1."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            factors = np.full(n, base, U)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def sums(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``digest`` takes the hash of any stretch."""
    out = np.zeros(len(tokens) + 1, U)
    np.cumsum(tokens * powers(len(tokens))[0], out=out[1:])
    return out


def digest(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start])


def digests_of_all(prefix: np.ndarray, length: int) -> np.ndarray:
    """The digest of every stretch of so many tokens."""
    return mixed((prefix[length:] - prefix[:-length]) * powers(len(prefix) - length)[1])


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        h = np.minimum(h[:-step], h[step:])
        reach += step
    return h


def runs_of(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the neighbouring places with one value in ``least``; places that aren't valid are left out."""
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(first, append=len(least))
    first, count = first[valid[first]], count[valid[first]]
    if len(count) and count.max() > LONGEST_RUN:
        parts = -(-count // LONGEST_RUN)
        head = np.cumsum(parts) - parts
        ends = np.repeat(first + count, parts)
        first = np.repeat(first, parts) + LONGEST_RUN * (np.arange(parts.sum()) - np.repeat(head, parts))
        count = np.minimum(LONGEST_RUN, ends - first)
    return first, count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of every stretch, one stretch after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def heads_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Which rows, sorted by these keys, are the first of their group."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def pack(arrays: Sequence[np.ndarray]) -> bytes:
    """The arrays, each as a plane for each of its bytes (high ones are mostly zeros and shrink), compressed."""
    body = b"".join(np.int64(len(a)).tobytes() + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else bytes(8) for a in arrays)
    return np.int64(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack(data: bytes, kinds: Sequence[type]) -> list[np.ndarray]:
    body = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n, size = int(np.frombuffer(body, np.int64, 1, at)[0]), np.dtype(kind).itemsize
        raw = np.frombuffer(body, np.uint8, n * size, at + 8)
        out.append(raw.reshape(size, n).T.copy().view(kind).reshape(-1) if size > 1 else raw.view(kind))
        at += 8 + n * size
    return out


def compared(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Whether the bytes of ``buffer`` from a and from b on are the same, for each length."""
    same = np.ones(len(a), bool)
    cuts = np.flatnonzero(np.diff(np.cumsum(length) // at_once, prepend=-1))
    for i, j in zip(cuts, np.append(cuts, len(a))[1:], strict=True):
        n = length[i:j]
        equal = buffer[spread(a[i:j], n)] == buffer[spread(b[i:j], n)]
        same[i:j] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


#: bucket: the digit's leading bits. kind 0: packed rows of that bucket; other kinds only go along.
DEALT = "bucket int, kind int, data binary"
DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def passes(docs: DataFrame) -> int:
    """How many passes leave at most about BUCKET_BYTES of text in a bucket."""
    return passes_for(docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def passes_for(total: int) -> int:
    return next(n for n in range(1, MOST_PASSES + 1) if total <= BUCKET_BYTES << PASS_BITS * n or n == MOST_PASSES)


def bucket_of(digit: np.ndarray, n_pass: int) -> np.ndarray:
    """A 32-bit digit's bucket in a pass, from 1 on: the most significant bits."""
    return (digit.astype(np.int64) >> (32 - PASS_BITS * n_pass)).astype(np.int32)


def dealt_in_passes(rows: DataFrame, n_passes: int, split: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """rows (DEALT, by the buckets of pass 1) dealt by those of the last pass, and sorted by them within partitions.

    split: from a pass's number and packed rows of one bucket to rows by the buckets of that pass.
    """

    def redeal(n_pass: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, bucket, size = [], None, 0
            for batch in batches:
                for at, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if kind:
                        yield batch_of(DEALT_ARROW, [[at], [kind], [data]])
                        continue
                    if held and (at != bucket or size > BUCKET_BYTES):
                        yield from split(n_pass, held)
                        held, size = [], 0
                    bucket = at
                    held.append(data)
                    size += len(data)
            if held:
                yield from split(n_pass, held)

        return run

    for n_pass in range(2, n_passes + 1):
        rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(redeal(n_pass), DEALT)
    return rows.repartition("bucket").sortWithinPartitions("bucket")


#: Windows in a span, as its low bits; its start in the higher ones.
SPAN_BITS = 31


def spans_of(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << SPAN_BITS) | windows.astype(np.int64)


def removed_tokens(spans: np.ndarray, n_tokens: int, length: int) -> np.ndarray:
    """Which tokens the windows of the spans cover."""
    edge = np.zeros(n_tokens + 1, np.int64)
    if len(spans):
        start, windows = spans >> SPAN_BITS, spans & ((1 << SPAN_BITS) - 1)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + windows + length - 1, -1)
    return np.cumsum(edge)[:n_tokens] > 0


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes, packed: texts compressed for their way through a shuffle; null texts are empty."""
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("n_bytes", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                raw = [t.encode() for t in part.column(1).to_pylist()]
                yield batch_of(arrow, [part.column(0), part.column(2), [len(r) for r in raw], [pa.compress(r, "zstd", asbytes=True) if r else b"" for r in raw]])

    return keyed_texts(docs).mapInArrow(run, f"doc_id long, {TEXT_KEY} long, n_bytes long, packed binary")


def unpacked_text(packed: bytes, n_bytes: int) -> bytes:
    return pa.decompress(packed, n_bytes, "zstd", asbytes=True) if n_bytes else b""


def rewritten(docs: DataFrame, spans: DataFrame, row: Callable[[int, int, bytes, np.ndarray], tuple], arrow: pa.Schema, schema: str) -> DataFrame:
    """``row`` (doc_id, text_key, text's bytes, spans) of every row of docs, as columns of ``schema``.

    spans: rows of doc_id, text_key, span.
    """
    of_documents = spans.groupBy("doc_id", TEXT_KEY).agg(F.collect_list("span").alias("spans"))
    joined = packed_texts(docs).join(of_documents, ["doc_id", TEXT_KEY], "left").select("doc_id", TEXT_KEY, "packed", "n_bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                ids, keys, texts, sizes = (part.column(i).to_pylist() for i in range(4))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part.column(4)), 0).to_numpy(zero_copy_only=False))
                flat = part.column(4).flatten().to_numpy(zero_copy_only=False)
                rows = [row(i, k, unpacked_text(t, n), flat[a:b]) for i, k, t, n, a, b in zip(ids, keys, texts, sizes, [0, *ends.tolist()], ends.tolist(), strict=False)]
                yield batch_of(arrow, [[r[i] for r in rows] for i in range(len(arrow))])

    return joined.mapInArrow(run, schema)
