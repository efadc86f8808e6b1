"""Statistics of a text that rules and classifiers use: counts, and shares that don't depend on the length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TEXT_KEY, batch_of, column, keyed_texts, slices
from .debruijn import word_tokens
from .repeats import digest, sums

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
WHITE = np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)
#: Of each byte: 0 white space, 2 a letter, a digit or beyond ASCII, 1 any other.
KIND = np.array([0 if bytes([b]).isspace() else 2 if b > 127 or bytes([b]).isalnum() else 1 for b in range(256)], np.uint8)
#: Words in a window that counts as repeated.
REPEAT_WORDS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "same_as_before", "repeat_words", "dup_lines", "words_a_line",
    "symbols", "pipes", "exclamations", "commas", "full_stops", "other_punctuation", "upper", "digits", "beyond_ascii", "bare_words", "entropy",
)


def repeat_words(tokens: np.ndarray) -> int:
    """Words in windows that stand twice or more in the text, the first ones included."""
    n = len(tokens) - REPEAT_WORDS + 1
    if n < 2:
        return 0
    at = np.arange(n)
    h = digest(sums(tokens), at, at + REPEAT_WORDS)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    edge = np.zeros(len(tokens) + 1, np.int64)
    edge[:n] += often
    edge[REPEAT_WORDS:] -= often
    return int(np.count_nonzero(np.cumsum(edge)[: len(tokens)]))


def named_words(data: bytes) -> int:
    """Words with a letter, a digit or a byte over 127."""
    kind = KIND[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero((kind > 0) & (np.concatenate([[0], kind[:-1]]) == 0))
    return int(np.count_nonzero(np.maximum.reduceat(kind, starts) == 2)) if len(starts) else 0


def statistics(text: str) -> tuple[tuple[int, ...], np.ndarray]:
    """COUNTS and SHARES of a whole text; an empty one has zeros."""
    data = text.encode()
    words = data.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = data.split(b"\n")
    full = [line for line in lines if line.strip()]
    n_dup = len(full) - len(set(full))
    n_symbols = int(by_byte[SYMBOLS].sum())
    white = int(by_byte[WHITE].sum())
    tokens = word_tokens(data)
    repeated = repeat_words(tokens)
    counts = (n, len(text) - white, n_symbols, n_dup, repeated)
    if not n:
        return counts, np.zeros(len(SHARES), np.float32)
    solid = len(data) - white
    lengths = np.fromiter(map(len, words), np.int64, n)
    ordered = np.sort(tokens)
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    p = by_byte[by_byte > 0] / len(data)
    letters = int(by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[128:].sum())
    punctuation = int(by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum())
    named = n_symbols + int(by_byte[33] + by_byte[44] + by_byte[46])
    bare = n - named_words(data)
    shares = (
        np.log1p(n), lengths.mean(), lengths.std(), len(heads) / n ** 0.8, np.diff(heads, append=n).max() / (n + 10), np.count_nonzero(tokens[1:] == tokens[:-1]) / n,
        repeated / n, n_dup / max(1, len(full)), np.log1p(n / max(1, len(full))),
        n_symbols / solid, by_byte[124] / solid, by_byte[33] / solid, by_byte[44] / solid, by_byte[46] / solid, max(0, punctuation - named) / solid, by_byte[65:91].sum() / max(1, letters), by_byte[48:58].sum() / solid,
        by_byte[128:].sum() / solid, bare / n, float(-(p * np.log2(p)).sum()),
    )
    return counts, np.array(shares, np.float32)


SCHEMA = f"doc_id long, {TEXT_KEY} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", shares array<float>"


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, COUNTS and shares (an array in the order of SHARES) of every whole text; null texts are empty."""
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), *((c, pa.int64()) for c in COUNTS), ("shares", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [statistics(t) for t in column(batch, "text")]
                yield batch_of(arrow, [batch.column(0), batch.column(2), *([r[0][i] for r in rows] for i in range(len(COUNTS))), [r[1].tolist() for r in rows]])

    return keyed_texts(docs).mapInArrow(run, SCHEMA)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The shares of a batch, a row for each text."""
    shares = batch.column(batch.schema.get_field_index("shares"))
    return shares.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
