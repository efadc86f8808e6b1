"""Byte-level byte pair encoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. Every adjacent pair that the vocabulary knows waits in the
bucket of its rank; a bitmap of two levels says which buckets hold anything, so that find-first-set leads
to the lowest rank in two steps, whatever the pre-token's length. Entries of pairs that have changed
meanwhile stay in their buckets and are skipped when they surface.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, column, slices, texts

#: Bits of a bitmap word, at each of the two levels: room for 2 ** 18 ranks.
WORD = 9
#: Pre-tokens up to this many characters are remembered, so many of them at a time.
CACHED_CHARS, CACHED_TOKENS = 32, 800_000


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token. Every single byte has to have a rank, and ranks stay below 2 ** (2 * WORD)."""
    if token in ranks:
        return [ranks[token]]
    n, rank_of, low = len(token), ranks.get, (1 << WORD) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = after[:]  # where the part that starts here ends; 0 once it is merged away
    # The rank with which the pair that starts here waits; the last part has no pair.
    waiting = [rank_of(token[i : i + 2], -1) for i in range(n)]
    waiting[-1] = -1
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    fresh = [(rank, i) for i, rank in enumerate(waiting) if rank >= 0]
    while True:
        for rank, left in fresh:
            if rank in buckets:
                heappush(buckets[rank], left)
            else:
                buckets[rank] = [left]
                word = rank >> WORD
                if word in words:
                    words[word] |= 1 << (rank & low)
                else:
                    words[word] = 1 << (rank & low)
                    top |= 1 << word
        if not top:
            break
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word << WORD | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        left = heappop(bucket)  # the leftmost of this rank
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                words[word] = bits
            else:
                del words[word]
                top &= top - 1
        fresh = []
        if waiting[left] != rank:
            continue  # stale
        right = after[left]
        stop = end[left] = end[right]
        end[right], waiting[right] = 0, -1
        after[left] = following = after[right]
        if following < n:
            before[following] = left
            waiting[left] = rank = rank_of(token[left : end[following]], -1)
            if rank >= 0:
                fresh.append((rank, left))
        else:
            waiting[left] = -1
        if left:
            previous = before[left]
            waiting[previous] = rank = rank_of(token[previous:stop], -1)
            if rank >= 0:
                fresh.append((rank, previous))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = after[i]
    return out


#: Texts without characters from here on are split by Python's own faster pattern engine.
LATIN = 0x250


def _class(wanted: Callable[[str], bool]) -> str:
    return "".join(f"\\u{i:04x}" for i in range(LATIN) if wanted(chr(i)))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern``, a pattern of the regex library with groups that don't capture."""
    whole = regex.compile(pattern).findall
    plain = pattern
    for name, chars in ((r"\p{L}", _class(str.isalpha)), (r"\p{N}", _class(lambda c: unicodedata.category(c)[0] == "N"))):
        plain = re.sub(r"\[[^\]]*\]", lambda m, name=name, chars=chars: m[0].replace(name, chars), plain).replace(name, f"[{chars}]")
    spaces = _class(lambda c: regex.match(r"\s", c) is not None)
    plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", spaces), plain)
    plain = plain.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    if re.search(r"\\[pPwWdDbX]", plain):
        return whole
    quick, beyond = re.compile(plain).findall, re.compile(f"[^\\u0000-\\u{LATIN - 1:04x}]").search
    return lambda text: whole(text) if beyond(text) else quick(text)


class Encoder(dict):
    """Maps a pre-token to its ids as little-endian 32-bit integers; remembers short ones, in bounded number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.pieces = splitter(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: Encoders of this Python worker by vocabulary and pattern: kept from task to task.
_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    if (vocabulary, pattern) not in _encoders:
        with open(vocabulary, "rb") as f:
            _encoders[vocabulary, pattern] = Encoder(load_ranks(f.read()), pattern)
    return _encoders[vocabulary, pattern]


def _map(docs: DataFrame, vocabulary: str, pattern: str, schema: str, arrow: pa.Schema, row: Callable[[Encoder, str], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for whole in batches:
            for batch in slices(whole):
                rows = [row(enc, text or "") for text in column(batch, "text")]
                yield batch_of(arrow, [batch.column(0), *([r[i] for r in rows] for i in range(len(arrow) - 1))])

    return texts(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers in one binary) of every whole text.

    vocabulary: a rank file that every executor can open at this path. pattern: splits text into pre-tokens.
    Null and empty texts have no ids; repeated rows give repeated rows; a null doc_id stays null. Texts of any length are
    encoded whole; of pairs of one rank the first is merged first. An empty table gives no rows. Other columns take no
    part, whatever their names.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return _map(docs, vocabulary, pattern, "doc_id long, n_tokens long, ids binary", arrow, lambda enc, text: (len(ids := enc.encode(text)) // 4, ids))


def decode(encoded: DataFrame, vocabulary: str, pattern: str = "") -> DataFrame:
    """doc_id, decoded (binary) of rows with doc_id and ids; null ids give no bytes."""
    arrow = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for whole in batches:
            for batch in slices(whole):
                yield batch_of(arrow, [batch.column(0), [enc.decode(ids or b"") for ids in column(batch, "ids")]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, so that ids needn't be moved. Nulls, long texts,
    repeated rows, empty tables and other columns are as in ``encode``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(enc: Encoder, text: str) -> tuple[int, str, str]:
        ids = enc.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    return _map(docs, vocabulary, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow, row)


def round_trip_with_ids(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``round_trip`` and the ids themselves: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])

    def row(enc: Encoder, text: str) -> tuple[int, str, str, bytes]:
        ids = enc.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest(), ids

    return _map(docs, vocabulary, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary", arrow, row)
