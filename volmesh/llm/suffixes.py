"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the order of suffixes through ``depth`` bytes matters: suffixes that agree so far form a group, and the groups
of two or more are the repeated windows. Passes go from the most significant digit on:

1. Spark deals suffixes out by their window's minimizer, which neighbours share: they travel as one run. Equal windows
   have equal minimizers. Digits that only one document has are done. Runs of one digit that have one digest of their
   bytes are the same; all but the first document's are repeats. These digests are 96 bits of BLAKE2b under a key that is
   drawn anew for every job, so no text can be made to collide; by chance, 5e-14 pairs of 100 TB are expected to.
2. What is left are mostly runs at the ends of passages. They are dealt out again by their digits, with the bytes that
   they span. In a bucket, runs with the very same bytes are one. Every suffix of the others is sorted by its own
   bytes, eight at a time, from the first on. After each pass only groups with suffixes of several documents stay, so
   few suffixes are compared through the full depth. All of this compares bytes, not hashes.

Runs with the same bytes are made one in each batch of documents, before they are moved: a passage that a third of all
documents hold comes once from each batch. A bucket's memory is bounded: where one digit's runs would exceed it, they go
from the first step to the second as they are, and there their suffixes are dealt out once more, each by a hash of all
of its window's bytes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, checkpointed, column, keyed_texts, released, slices
from .repeats import CHUNK, DEALT, DEALT_ARROW, PASS_BITS, SPAN_BITS, U, bucket_of, compared, dealt_in_passes, digest, digests_of_all, heads_of, mixed, pack, packed_texts, passes, passes_for, removed_tokens, rewritten, runs_of, sliding_least, spans_of, spread, sums, unpack, unpacked_text

#: Windows of a document that are hashed as one piece; suffixes that are sorted at a time; runs in a batch that is sent.
PIECE, SORTED, BATCH = 1 << 17, 1 << 20, 1 << 19
#: Bytes of runs that a bucket may hold in a task before its largest digits are dealt out anew.
HELD_BYTES = 192 << 20

_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Packed: ids and keys of documents, the number of runs of each; start, windows, digit of the runs; their bytes.
PACKED = (np.int64, np.int64, np.int32, np.int32, np.uint16, np.uint32, np.uint8)
#: Kinds of rows of DEALT.
RUNS, REPEATS = 0, 1
#: A span, or a packed row of suffixes that are to be dealt out once more.
FOUND = f"doc_id long, {TEXT_KEY} long, span long, bucket int, data binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("span", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


@dataclass
class Runs:
    """Runs of suffixes: ids (doc_id, text_key) of documents; doc: index of a run's; start and number of its suffixes;
    digit; at: where its bytes begin in ``bytes``."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    digit: np.ndarray
    at: np.ndarray
    bytes: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Runs:
        return Runs(self.ids, self.doc[which], self.start[which], self.windows[which], self.digit[which], self.at[which], self.bytes)

    def packed(self, depth: int, *, with_bytes: bool = True) -> bytes:
        """Of runs sorted by document."""
        head = np.flatnonzero(heads_of(self.doc))
        body = self.bytes[spread(self.at, self.windows + depth - 1)] if with_bytes else np.zeros(0, np.uint8)
        own = self.ids[self.doc[head]]
        return pack((own[:, 0].copy(), own[:, 1].copy(), np.diff(head, append=len(self.doc)).astype(np.int32), self.start.astype(np.int32), self.windows.astype(np.uint16), self.digit, body))

    def dealt(self, depth: int, n_pass: int) -> pa.RecordBatch:
        """Packed rows by the buckets of a pass."""
        bucket = bucket_of(self.digit, n_pass)
        order = np.lexsort((self.start, self.doc, bucket))
        sorted_, bucket = self[order], bucket[order]
        cut = np.flatnonzero(heads_of(bucket))
        data = [sorted_[np.arange(a, b)].packed(depth) for a, b in zip(cut, np.append(cut, len(bucket))[1:], strict=True)]
        return batch_of(DEALT_ARROW, [bucket[cut], np.full(len(cut), RUNS, np.int32), data])


def unpacked(data: list[bytes], depth: int) -> Runs:
    ids, doc, start, windows, digit, body, n = [], [], [], [], [], [], 0
    for d in data:
        own, keys, runs, s, w, g, b = unpack(d, PACKED)
        ids.append(np.stack([own, keys], axis=1))
        doc.append(np.repeat(np.arange(n, n + len(own)), runs).astype(np.int32))
        n += len(own)
        for to, x in ((start, s), (windows, w.astype(np.int32)), (digit, g), (body, b)):
            to.append(x)
    windows = np.concatenate(windows)
    length = windows.astype(np.int64) + depth - 1
    return Runs(np.concatenate(ids), np.concatenate(doc), np.concatenate(start), windows, np.concatenate(digit), np.cumsum(length) - length, np.concatenate(body))


def same_bytes(runs: Runs, key: np.ndarray, depth: int) -> np.ndarray:
    """Which runs have the bytes of one of a smaller doc_id that stays. key: equal wherever the bytes are."""
    rank = np.empty(len(runs.ids), np.int64)
    rank[np.lexsort((runs.ids[:, 1], runs.ids[:, 0]))] = np.arange(len(runs.ids))
    order = np.lexsort((runs.start, rank[runs.doc], key))
    new = heads_of(key[order])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    may = (runs.ids[runs.doc[order], 0] != runs.ids[runs.doc[first], 0]) & (runs.windows[order] == runs.windows[first])
    order, first = order[may], first[may]
    repeated = np.zeros(len(runs.doc), bool)
    repeated[order] = compared(runs.bytes, runs.at[order], runs.at[first], runs.windows[order] + depth - 1)
    return repeated


def sorted_groups(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, doc_id: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes that begin ``at`` places of ``buffer`` (8 bytes longer than they reach) equal, through
    ``depth`` bytes, a suffix of a smaller doc_id in their group."""
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))
    live, repeated = np.arange(len(at)), np.zeros(len(at), bool)
    for byte in range(0, depth, 8):
        word = words[at[live] + byte].astype(U)
        if depth - byte < 8:
            word >>= U(8 * (8 - depth + byte))
        order = np.lexsort((word, group))
        live, word, group = live[order], word[order], group[order]
        new = heads_of(word, group)
        head = np.flatnonzero(new)
        own = doc_id[live]
        least = np.repeat(np.minimum.reduceat(own, head), np.diff(head, append=len(own)))
        stays = np.repeat(np.maximum.reduceat(own, head), np.diff(head, append=len(own))) > least
        live, group, own, least = live[stays], np.cumsum(new)[stays], own[stays], least[stays]
        if not len(live):
            return repeated
    repeated[live] = own > least
    return repeated


def _runs_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Piece, first byte, windows, digit and digest of the runs of the pieces [starts, stops) of ``data``."""
    prefix = sums(_BYTE_HASHES[data])
    least = sliding_least(digests_of_all(prefix, gram), depth - gram + 1)
    piece = np.repeat(np.arange(len(starts)), stops - starts)[: len(least)]
    first, count = runs_of(least, np.arange(len(least)) + depth <= stops[piece])
    return piece[first], first, count, least[first].astype(np.uint32), digest(prefix, first, first + count + depth - 1)


#: Packed: ids and keys of documents, the number of runs of each; start, windows, digit and the digest's two parts of the runs.
SIFTED = (np.int64, np.int64, np.int32, np.int32, np.uint16, np.uint32, np.uint64, np.uint32)
DIGEST = np.dtype([("high", np.uint64), ("low", np.uint32)])
#: A span that is repeated; with a digit, a run whose suffixes have to be sorted.
KNOWN = f"doc_id long, {TEXT_KEY} long, span long, digit long"
KNOWN_ARROW = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("span", pa.int64()), ("digit", pa.int64())])
#: Runs without their bytes that a bucket may hold in a task.
HELD_RUNS = 1 << 22


def strong_digests(data: np.ndarray, at: np.ndarray, length: np.ndarray, key: bytes) -> np.ndarray:
    """DIGEST of each stretch of bytes."""
    view, keyed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b(key=key, digest_size=DIGEST.itemsize)
    out = []
    for a, b in zip(at.tolist(), (at + length).tolist(), strict=True):
        h = keyed.copy()
        h.update(view[a:b])
        out.append(h.digest())
    return np.frombuffer(b"".join(out), DIGEST)


def _repeats_row(runs: Runs, repeated: np.ndarray, depth: int) -> pa.RecordBatch:
    gone = runs[np.flatnonzero(repeated)]
    gone = gone[np.argsort(gone.doc, kind="stable")]
    return batch_of(DEALT_ARROW, [[int(gone.ids[gone.doc[0], 1]) % (1 << PASS_BITS)], [REPEATS], [gone.packed(depth, with_bytes=False)]])


def _sifting_rows(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, digit: np.ndarray, high: np.ndarray, low: np.ndarray, n_pass: int) -> pa.RecordBatch:
    """Rows of SIFTED by the buckets of a pass."""
    bucket = bucket_of(digit, n_pass)
    order = np.lexsort((start, doc, bucket))
    cut = np.flatnonzero(heads_of(bucket[order]))
    data = []
    for a, b in zip(cut, np.append(cut, len(order))[1:], strict=True):
        own = order[a:b]
        head = np.flatnonzero(heads_of(doc[own]))
        of = ids[doc[own[head]]]
        data.append(pack((of[:, 0].copy(), of[:, 1].copy(), np.diff(head, append=len(own)).astype(np.int32), start[own].astype(np.int32), windows[own].astype(np.uint16), digit[own], high[own], low[own])))
    return batch_of(DEALT_ARROW, [bucket[order][cut], np.full(len(cut), RUNS, np.int32), data])


def _unsifted(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids; document, start, windows, digit, both parts of the digest of runs."""
    ids, doc, fields, n = [], [], [], 0
    for d in data:
        own, keys, runs, *rest = unpack(d, SIFTED)
        ids.append(np.stack([own, keys], axis=1))
        doc.append(np.repeat(np.arange(n, n + len(own)), runs))
        n += len(own)
        fields.append(rest)
    start, windows, digit, high, low = (np.concatenate(x) for x in zip(*fields, strict=True))
    return np.concatenate(ids), np.concatenate(doc), start.astype(np.int64), windows.astype(np.int64), digit, high, low


def _dealt(docs: DataFrame, depth: int) -> DataFrame:
    """DEALT of the runs of all documents, without their bytes; rows without doc_id take no part."""
    gram = max(1, 2 * depth // 5)
    secret = secrets.token_bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        bodies: list[np.ndarray] = []
        pieces: list[tuple[int, int, bytes]] = []
        size = n_runs = 0

        def hashed() -> None:
            nonlocal size, n_runs
            if pieces:
                data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
                stops = np.cumsum([len(p[2]) for p in pieces])
                starts = stops - [len(p[2]) for p in pieces]
                doc, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
                piece, first, count, digit, digests = _runs_of(data, starts, stops, depth, gram)
                parts.append((doc[piece], first - starts[piece] + offset[piece], count, digit, first + sum(map(len, bodies)), digests))
                bodies.append(data)
                n_runs += len(first)
            pieces.clear()
            size = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal n_runs
            if n_runs:
                doc, start, count, digit, at, digests = (np.concatenate(x) for x in zip(*parts, strict=True))
                runs = Runs(np.array(ids, np.int64).reshape(-1, 2), doc, start, count, digit, at, np.concatenate(bodies))
                repeated = same_bytes(runs, digests, depth)
                if repeated.any():
                    yield _repeats_row(runs, repeated, depth)
                rest = ~repeated
                strong = strong_digests(runs.bytes, at[rest], count[rest] + depth - 1, secret)
                yield _sifting_rows(runs.ids, doc[rest], start[rest], count[rest], digit[rest], strong["high"], strong["low"], 1)
            ids.clear(), parts.clear(), bodies.clear()
            n_runs = 0

        for whole in batches:
            for part in slices(whole):
                for doc_id, key, text in zip(column(part, "doc_id"), column(part, TEXT_KEY), column(part, "text"), strict=True):
                    data = text.encode()
                    if len(data) < depth:
                        continue
                    ids.append((doc_id, key))
                    for at in range(0, len(data) - depth + 1, PIECE):
                        pieces.append((len(ids) - 1, at, data[at : at + PIECE + depth - 1]))
                        size += len(pieces[-1][2])
                        if size >= CHUNK:
                            hashed()
                    if n_runs >= BATCH:
                        hashed()
                        yield from send()
        hashed()
        yield from send()

    return keyed_texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, DEALT)


def _known(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, digit: np.ndarray | None = None) -> pa.RecordBatch:
    own = ids[doc]
    return batch_of(KNOWN_ARROW, [own[:, 0], own[:, 1], spans_of(start, windows), [None] * len(doc) if digit is None else digit.astype(np.int64)])


def _sifted(dealt: DataFrame, depth: int, held_runs: int) -> DataFrame:
    """KNOWN of sorted rows of DEALT: runs that repeat another document's, and runs of digits that several have."""

    def settled(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, digit: np.ndarray, high: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        order = np.lexsort((start, ids[doc, 1], ids[doc, 0], low, high, digit))
        doc, start, windows, digit, high, low = (x[order] for x in (doc, start, windows, digit, high, low))
        new = heads_of(digit, high, low)
        own = ids[doc, 0]
        repeated = own != own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        yield _known(ids, doc[repeated], start[repeated], windows[repeated])
        doc, start, windows, digit, own = (x[~repeated] for x in (doc, start, windows, digit, own))
        head = np.flatnonzero(heads_of(digit))
        several = np.repeat(np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head), np.diff(head, append=len(own)))
        yield _known(ids, doc[several], start[several], windows[several], digit[several])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        hot = np.zeros(0, np.uint32)
        bucket, n = None, 0

        def without_hot(runs: tuple[np.ndarray, ...]) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
            """Runs of hot digits all have their suffixes sorted; the others."""
            ids, *rest = runs
            gone = np.isin(rest[3], hot)
            return _known(ids, *(x[gone] for x in rest[:4])), (ids, *(x[~gone] for x in rest))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, hot
            if held:
                sent, rest = without_hot(_unsifted(held))
                yield sent
                yield from settled(*rest)
            held, n, hot = [], 0, hot[:0]

        for batch in batches:
            for at, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == REPEATS:
                    own = unpacked([data], depth)
                    yield _known(own.ids, own.doc, own.start, own.windows)
                    continue
                if at != bucket:
                    yield from close()
                    bucket = at
                held.append(data)
                n += int(np.frombuffer(data[:8], np.int64)[0]) // 22
                if n > held_runs:
                    runs = _unsifted(held)
                    digits, count = np.unique(runs[4], return_counts=True)
                    order = np.argsort(-count)
                    # Largest first, until half of what may be held is left.
                    hot = np.union1d(hot, digits[order[: int(np.searchsorted(np.cumsum(count[order]), len(runs[1]) - held_runs // 2)) + 1]])
                    sent, rest = without_hot(runs)
                    yield sent
                    ids, doc, start, windows, digit, high, low = rest
                    own, doc = np.unique(doc, return_inverse=True)
                    held, n = [], len(doc)
                    if n:
                        head = np.flatnonzero(heads_of(doc))
                        of = ids[own]
                        held = [pack((of[:, 0].copy(), of[:, 1].copy(), np.diff(head, append=n).astype(np.int32), start.astype(np.int32), windows.astype(np.uint16), digit, high, low))]
        yield from close()

    return dealt.mapInArrow(run, KNOWN)


def _ends_key(runs: Runs, depth: int) -> np.ndarray:
    """Equal wherever the digits and bytes of runs are."""
    words = np.ndarray((len(runs.bytes) - 7,), ">u8", np.ascontiguousarray(runs.bytes), 0, (1,))
    ends = np.maximum(runs.at, runs.at + runs.windows + depth - 9)
    key = mixed(words[runs.at].astype(U)) + words[(runs.at + ends) // 2].astype(U) * U(3) + mixed(words[ends].astype(U) ^ runs.digit.astype(U))
    return mixed(key ^ runs.windows.astype(U))


def _with_bytes(open_: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """DEALT of the open runs (of KNOWN), with their bytes."""
    of_documents = open_.groupBy("doc_id", TEXT_KEY).agg(F.collect_list(F.struct("span", "digit")).alias("runs"))
    joined = of_documents.join(packed_texts(docs), ["doc_id", TEXT_KEY]).select("doc_id", TEXT_KEY, "packed", "n_bytes", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        bodies: list[bytes] = []
        parts: list[tuple[np.ndarray, ...]] = []
        n = size = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal n, size
            if n:
                doc, start, windows, digit, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                runs = Runs(np.array(ids, np.int64).reshape(-1, 2), doc, start, windows, digit, at, np.frombuffer(b"".join([*bodies, bytes(8)]), np.uint8))
                repeated = same_bytes(runs, _ends_key(runs, depth), depth)
                if repeated.any():
                    yield _repeats_row(runs, repeated, depth)
                yield runs[np.flatnonzero(~repeated)].dealt(depth, 1)
            ids.clear(), bodies.clear(), parts.clear()
            n = size = 0

        for whole in batches:
            for part in slices(whole):
                for doc_id, key, text, n_bytes, runs in zip(*(part.column(i) for i in range(5)), strict=True):
                    span = runs.values.field("span").to_numpy()
                    data = unpacked_text(text.as_py(), n_bytes.as_py())
                    ids.append((doc_id.as_py(), key.as_py()))
                    start = span >> SPAN_BITS
                    parts.append((np.full(len(span), len(ids) - 1), start, span & ((1 << SPAN_BITS) - 1), runs.values.field("digit").to_numpy().astype(np.uint32), start + size))
                    bodies.append(data)
                    size += len(data)
                    n += len(span)
                    if n >= BATCH // 4 or size >= 16 * BATCH:
                        yield from send()
        yield from send()

    return joined.mapInArrow(run, DEALT)


def _spans(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """FOUND of repeated windows; those that follow on each other are joined."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), start[order].astype(np.int64) + windows[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(stop, first) if len(first) else stop
    none = [None] * len(first)
    return batch_of(FOUND_ARROW, [ids[doc[first], 0], ids[doc[first], 1], spans_of(start[first], stop - start[first]), none, none])


def _suffixes(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, start and place of the bytes of every suffix."""
    run = np.repeat(np.arange(len(runs.doc)), runs.windows)
    return run, spread(runs.start.astype(np.int64), runs.windows), spread(runs.at, runs.windows)


def resolved(runs: Runs, depth: int) -> Iterator[pa.RecordBatch]:
    """FOUND of all runs of some digits."""
    buffer = np.append(runs.bytes, np.zeros(8, np.uint8))
    runs = Runs(runs.ids, runs.doc, runs.start, runs.windows, runs.digit, runs.at, buffer)
    repeated = same_bytes(runs, _ends_key(runs, depth), depth)
    if repeated.any():
        gone = runs[repeated]
        yield _spans(runs.ids, gone.doc, gone.start, gone.windows)
    runs = runs[~repeated]
    runs = runs[np.argsort(runs.digit, kind="stable")]
    head = np.flatnonzero(heads_of(runs.digit))
    size = np.diff(head, append=len(runs.digit))
    own = runs.ids[runs.doc, 0]
    several = np.repeat(np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head), size) if len(head) else np.zeros(0, bool)
    runs = runs[several]
    new = heads_of(runs.digit) if len(runs.digit) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    total = np.cumsum(runs.windows.astype(np.int64))
    if not len(head):
        return
    # Digits are sorted some at a time.
    before = (total - runs.windows)[head] // SORTED
    cut = head[np.flatnonzero(np.diff(before, prepend=-1))]
    for a, b in zip(cut, np.append(cut, len(runs.digit))[1:], strict=True):
        part = runs[np.arange(a, b)]
        run, start, at = _suffixes(part)
        found = sorted_groups(buffer, at, np.cumsum(new[a:b])[run], part.ids[part.doc, 0][run], depth)
        if found.any():
            yield _spans(part.ids, part.doc[run[found]], start[found], np.ones(int(found.sum()), np.int64))


def _anew(runs: Runs, depth: int) -> Iterator[pa.RecordBatch]:
    """FOUND with every suffix of the runs as a run of its own, dealt out by a hash of its window; what repeats among
    them is found here."""
    prefix = sums(_BYTE_HASHES[runs.bytes])
    for part in np.array_split(np.arange(len(runs.doc)), max(1, int(runs.windows.sum()) // BATCH)):
        own = runs[part]
        run, start, at = _suffixes(own)
        if not len(at):
            continue
        digests = digest(prefix, at, at + depth)
        single = Runs(own.ids, own.doc[run], start, np.ones(len(at), np.int32), digests.astype(np.uint32), at, own.bytes)
        repeated = same_bytes(single, digests, depth)
        if repeated.any():
            gone = single[repeated]
            yield _spans(gone.ids, gone.doc, gone.start, gone.windows)
        batch = single[np.flatnonzero(~repeated)].dealt(depth, 1)
        none = [None] * batch.num_rows
        yield batch_of(FOUND_ARROW, [none, none, none, batch.column(0), batch.column(2)])


def _resolved(dealt: DataFrame, depth: int, held_bytes: int) -> DataFrame:
    """FOUND of sorted rows of DEALT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        hot: set[int] = set()
        bucket, size = None, 0

        def large(runs: Runs) -> Iterator[pa.RecordBatch]:
            """Sends the largest digits on and holds the others."""
            nonlocal held, size
            digits, place = np.unique(runs.digit, return_inverse=True)
            weight = np.bincount(place, runs.windows + depth - 1.0)
            order = np.argsort(-weight)
            # Largest first, until half of what may be held is left.
            hot.update(digits[order[: int(np.searchsorted(np.cumsum(weight[order]), weight.sum() - held_bytes / 2)) + 1]].tolist())
            gone = np.isin(runs.digit, np.fromiter(hot, np.uint32, len(hot)))
            yield from _anew(runs[gone], depth)
            rest = runs[np.flatnonzero(~gone)]
            rest = rest[np.argsort(rest.doc, kind="stable")]
            held = [rest.packed(depth)] if len(rest.doc) else []
            size = int((rest.windows + depth - 1).sum())

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                runs = unpacked(held, depth)
                if hot:
                    gone = np.isin(runs.digit, np.fromiter(hot, np.uint32, len(hot)))
                    yield from _anew(runs[gone], depth)
                    runs = runs[~gone]
                yield from resolved(runs, depth)
            held, size = [], 0
            hot.clear()

        for batch in batches:
            for at, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == REPEATS:
                    own = unpacked([data], depth)
                    yield _spans(own.ids, own.doc, own.start, own.windows)
                    continue
                if at != bucket:
                    yield from close()
                    bucket = at
                held.append(data)
                size += int(np.frombuffer(data[:8], np.int64)[0])
                if size > held_bytes:
                    yield from large(unpacked(held, depth))
        yield from close()

    return dealt.mapInArrow(run, FOUND)


def repeated_suffixes(docs: DataFrame, depth: int = 50, held_bytes: int = HELD_BYTES, held_runs: int = HELD_RUNS) -> DataFrame:
    """doc_id, text_key, span: places of strings of ``depth`` bytes that start in a document with a smaller doc_id."""
    n = passes(docs)

    def split(n_pass: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield unpacked(data, depth).dealt(depth, n_pass)

    def split_sifting(n_pass: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield _sifting_rows(*_unsifted(data), n_pass)

    known = released(checkpointed(_sifted(dealt_in_passes(_dealt(docs, depth), n, split_sifting), depth, held_runs)))
    opened = _with_bytes(known.where("digit IS NOT NULL"), docs, depth)
    found = released(checkpointed(_resolved(dealt_in_passes(opened, n, split), depth, held_bytes)))
    anew = found.where("data IS NOT NULL").select("bucket", F.lit(RUNS).alias("kind"), "data")
    # Windows dealt out by a hash of all their bytes spread evenly; as many passes as leave a bucket little of them.
    n_anew = passes_for(anew.agg(F.sum(F.octet_length("data"))).first()[0] or 0)
    again = _resolved(dealt_in_passes(anew, n_anew, split), depth, 1 << 62)
    return reduce(DataFrame.union, (x.select("doc_id", TEXT_KEY, "span") for x in (known.where("digit IS NULL"), found.where("data IS NULL"), again)))


def remove_repeated_bytes(docs: DataFrame, depth: int = 50, held_bytes: int = HELD_BYTES, held_runs: int = HELD_RUNS) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 per row of docs.

    A byte goes if a string of ``depth`` bytes that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input. Null texts are empty; texts shorter than depth stay whole, texts of any length
    are compared whole. Repeated rows are treated alike and don't remove each other's bytes, nor do rows that share
    a doc_id. Rows without doc_id stay whole and remove nothing. An empty table gives no rows; other columns of docs
    take no part, whatever their names.
    """
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def row(doc_id: int, key: int, data: bytes, spans: np.ndarray) -> tuple:
        if not len(spans):
            return doc_id, key, len(data), 0, 0, data, hashlib.sha256(data).hexdigest()
        gone = removed_tokens(spans, len(data), depth)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return doc_id, key, len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), kept, hashlib.sha256(kept).hexdigest()

    return rewritten(docs, repeated_suffixes(docs, depth, held_bytes, held_runs), row, arrow, f"doc_id long, {TEXT_KEY} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
