"""Removal of repeated passages by a compacted De Bruijn graph of token k-mers.

A window of ``length`` words is an edge from the vertex of its first length - 1 words to that of its last ones.

1. Vertices go to buckets by their minimizer; neighbouring vertices of a document with one minimizer travel as one
   row, with the vertices before and after them. So a bucket sees every occurrence of its vertices with the edges
   that lead in and out, and each edge in the bucket of the vertex it leaves. In each batch of documents, rows with
   the same words are sent once; the other occurrences refer to the first.
2. A bucket finds each edge's source: where it occurs before in its document, else where it occurs first. Edges in a row
   whose sources follow on are a path: at the vertices between them the document's walk and the source's don't part.
   Inside a row a path can only begin or end at a vertex with several ways in or out, one of which the document takes
   and another its source. A walk around and around a cycle (words that repeat at once) has itself as its source.
3. Spark joins compact: occurrences take the paths of the row they refer to, and paths are joined to those that go
   on at the vertex where they end.
4. In the end each path is read at both of its coordinates. Where the words differ, hashes have collided: its windows
   are compared one by one, and those that still differ are grouped by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, checkpointed, column, keyed_texts, slices
from .repeats import BATCH, CHUNK, DEALT, DEALT_ARROW, PASS_BITS, SPAN_BITS, U, bucket_of, dealt_in_passes, digest, digests_of_all, heads_of, pack, passes, removed_tokens, rewritten, runs_of, sliding_least, spread, sums, unpack

#: Word hashes that a worker remembers at a time.
CACHED_WORDS = 150_000
#: Bytes of a vertex's hash that are sent beside its row's digit.
VERTEX_BYTES = 5


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _WordHashes()


def word_tokens(data: bytes) -> np.ndarray:
    words = data.split()  # bytes: splits at ASCII white space only
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: Kinds of rows of DEALT: rows of vertices; occurrences that refer to another one's row in the same batch.
ROWS, OCCURRENCES = 0, 1
#: Packed rows of vertices: ids and keys of documents, the number of rows of each; first vertex, number of vertices
#: and digit of the rows, whether others refer to them; the vertices, with the ones before and after (0: none).
PACKED = (np.int64, np.int64, np.int32, np.int32, np.uint16, np.uint32, np.uint8, *[np.uint8] * VERTEX_BYTES)
#: Packed occurrences: doc_id, key, first edge, edges; doc_id, key and first edge of the one that they refer to.
REFERRING = (np.int64, np.int64, np.int32, np.uint16, np.int64, np.int64, np.int32)

#: A path of edges of a document with the place of an earlier occurrence. kind PATH: the document's own. REFERRED: of
#: a row from edge ``row`` on that others refer to, first occurrences included (they are their own source).
#: REFERENCE: edges from ``start`` on that occur at the source's row.
PATH, REFERRED, REFERENCE = 0, 1, 2
NAMES = ("kind", "doc_id", TEXT_KEY, "row", "start", "windows", "source_doc", "source_key", "source_start")
PATHS = f"kind int, doc_id long, {TEXT_KEY} long, row int, start int, windows int, source_doc long, source_key long, source_start int"
PATHS_ARROW = pa.schema([(n, pa.int64() if n in ("doc_id", TEXT_KEY, "source_doc", "source_key") else pa.int32()) for n in NAMES])


def _rows_of(tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All vertices' hashes; document, first vertex, number, digit of their rows; digests of the rows' words with the
    vertices before and after."""
    wide = length - 1
    gram = max(1, length // 4)
    prefix = sums(tokens)
    vertices = digests_of_all(prefix, wide)
    least = sliding_least(digests_of_all(prefix, gram), wide - gram + 1)
    doc = np.repeat(np.arange(len(starts)), stops - starts)[: len(least)]
    first, count = runs_of(least, np.arange(len(least)) + wide <= stops[doc])
    doc = doc[first]
    before, after = first > starts[doc], first + count + wide <= stops[doc]
    words = digest(prefix, first - before, first + count - 1 + after + wide)
    return vertices, doc, first, count, least[first].astype(np.uint32), words ^ (before.astype(U) << U(1)) ^ after.astype(U)


def _dealt(docs: DataFrame, length: int, hash_bits: int) -> DataFrame:
    """DEALT of all vertices of all documents; rows without doc_id take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        hashes: list[np.ndarray] = []
        texts: list[tuple[int, np.ndarray]] = []
        size = n_rows = 0

        def hashed() -> None:
            nonlocal size, n_rows
            if texts:
                stops = np.cumsum([len(t) for _, t in texts])
                starts = stops - [len(t) for _, t in texts]
                vertices, doc, first, count, digit, words = _rows_of(np.concatenate([t for _, t in texts]), starts, stops, length)
                last = stops[doc] - first - length + 1 >= count  # an edge leaves the last vertex
                base = sum(map(len, hashes))
                parts.append((np.array([i for i, _ in texts])[doc], first - starts[doc], count, digit, words, first + base, first > starts[doc], last))
                hashes.append(vertices)
                n_rows += len(first)
            texts.clear()
            size = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal n_rows
            if n_rows:
                yield from _sent(np.array(ids, np.int64).reshape(-1, 2), np.concatenate(hashes), *(np.concatenate(x) for x in zip(*parts, strict=True)))
            ids.clear(), parts.clear(), hashes.clear()
            n_rows = 0

        for whole in batches:
            for part in slices(whole):
                for doc_id, key, text in zip(column(part, "doc_id"), column(part, TEXT_KEY), column(part, "text"), strict=True):
                    if len(text) < 2 * length - 1:
                        continue
                    tokens = word_tokens(text.encode()) & U((1 << hash_bits) - 1)
                    if len(tokens) < length:
                        continue
                    ids.append((doc_id, key))
                    texts.append((len(ids) - 1, tokens))
                    size += len(tokens)
                    if size >= CHUNK:
                        hashed()
                        if n_rows >= BATCH:
                            yield from send()
        hashed()
        yield from send()

    return keyed_texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, DEALT)


def _sent(ids: np.ndarray, vertices: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, digit: np.ndarray, words: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids[:, 1], ids[:, 0]))] = np.arange(len(ids))
    order = np.lexsort((start, rank[doc], words))
    new = heads_of(words[order])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    again = ~new & (count[order] == count[first])
    other = (start[order] != start[first]) | (ids[doc[order]] != ids[doc[first]]).any(axis=1)  # a row that is there twice doesn't repeat itself
    gone, source = order[again & other], first[again & other]
    edges = count[gone] - ~after[gone]
    gone, source, edges = gone[edges > 0], source[edges > 0], edges[edges > 0]
    if len(gone):
        by = np.lexsort((start[gone], doc[gone]))
        gone, source, edges = gone[by], source[by], edges[by]
        referring = (ids[doc[gone], 0], ids[doc[gone], 1], start[gone].astype(np.int32), edges.astype(np.uint16), ids[doc[source], 0], ids[doc[source], 1], start[source].astype(np.int32))
        yield batch_of(DEALT_ARROW, [[int(ids[0, 1]) % (1 << PASS_BITS)], [OCCURRENCES], [pack(referring)]])
    referred = np.zeros(len(doc), bool)
    referred[source] = True
    keep = order[~again]
    bucket = bucket_of(digit, 1)
    keep = keep[np.lexsort((start[keep], doc[keep], bucket[keep]))]
    cut = np.flatnonzero(heads_of(bucket[keep]))
    data = []
    for a, b in zip(cut, np.append(cut, len(keep))[1:], strict=True):
        own = keep[a:b]
        place = spread(at[own] - 1, count[own] + 2)
        sent = np.maximum(vertices[np.clip(place, 0, len(vertices) - 1)] & U((1 << 8 * VERTEX_BYTES) - 1), U(1))
        ends = np.cumsum(count[own] + 2)
        sent[(ends - count[own] - 2)[~before[own]]] = 0
        sent[(ends - 1)[~after[own]]] = 0
        data.append(_packed(ids, doc[own], start[own], count[own], digit[own], referred[own], sent))
    yield batch_of(DEALT_ARROW, [bucket[keep][cut], np.full(len(cut), ROWS, np.int32), data])


def _packed(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, digit: np.ndarray, referred: np.ndarray, sent: np.ndarray) -> bytes:
    """Of rows sorted by document."""
    head = np.flatnonzero(heads_of(doc))
    own = ids[doc[head]]
    planes = np.ascontiguousarray(sent).view(np.uint8).reshape(-1, 8)
    return pack((own[:, 0].copy(), own[:, 1].copy(), np.diff(head, append=len(doc)).astype(np.int32), start.astype(np.int32), count.astype(np.uint16), digit, referred.astype(np.uint8), *(planes[:, i].copy() for i in range(VERTEX_BYTES))))


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids; document, first vertex, number, digit, referred of rows; vertices with the ones before and after."""
    ids, doc, fields, n = [], [], [], 0
    for d in data:
        own, keys, rows, *rest = unpack(d, PACKED)
        ids.append(np.stack([own, keys], axis=1))
        doc.append(np.repeat(np.arange(n, n + len(own)), rows))
        n += len(own)
        vertices = np.zeros((len(rest[4]), 8), np.uint8)
        vertices[:, :VERTEX_BYTES] = np.stack(rest[4:], axis=1)
        fields.append((*rest[:4], vertices.view(U).reshape(-1)))
    start, count, digit, referred, vertices = (np.concatenate(x) for x in zip(*fields, strict=True))
    return np.concatenate(ids), np.concatenate(doc), start.astype(np.int64), count.astype(np.int64), digit, referred.astype(bool), vertices


def _split(n_pass: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    ids, doc, start, count, digit, referred, vertices = _unpacked(data)
    bucket = bucket_of(digit, n_pass)
    order = np.lexsort((start, doc, bucket))
    at = np.cumsum(count + 2) - count - 2
    cut = np.flatnonzero(heads_of(bucket[order]))
    out = []
    for a, b in zip(cut, np.append(cut, len(order))[1:], strict=True):
        own = order[a:b]
        out.append(_packed(ids, doc[own], start[own], count[own], digit[own], referred[own], vertices[spread(at[own], count[own] + 2)]))
    yield batch_of(DEALT_ARROW, [bucket[order][cut], np.full(len(cut), ROWS, np.int32), out])


def _paths_in(data: list[bytes]) -> pa.RecordBatch:
    """PATHS of a bucket."""
    ids, doc, start, count, digit, referred, sent = _unpacked(data)
    rank = np.empty(len(ids), np.int64)
    by_id = np.lexsort((ids[:, 1], ids[:, 0]))
    new = (np.diff(ids[by_id], axis=0) != 0).any(axis=1)
    rank[by_id] = np.concatenate([[0], np.cumsum(new)])  # rows that are there twice have one rank
    ends = np.cumsum(count + 2)
    inner = np.ones(len(sent), bool)
    inner[ends - 1] = inner[ends - count - 2] = False
    place = np.flatnonzero(inner)
    row = np.repeat(np.arange(len(doc)), count)
    edge = spread(start, count)
    leaves = sent[place + 1] != 0
    row, edge, place = row[leaves], edge[leaves], place[leaves]
    # Hashes of 64 bits: the vertex, and as many bits of the digit as have room; then the vertex that follows.
    vertex = sent[place] | (digit[row].astype(U) << U(8 * VERTEX_BYTES))
    order = np.lexsort((edge, rank[doc[row]], sent[place + 1], vertex))
    row, edge, place, vertex = row[order], edge[order], place[order], vertex[order]
    new, of = heads_of(vertex, sent[place + 1]), rank[doc[row]]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    # An edge's source is the one before it in its document; there, walks around a cycle are one path.
    here = heads_of(np.cumsum(new), of, edge)
    here = np.flatnonzero(here)[np.cumsum(here) - 1]
    before = np.where((here > first) & (of[here - 1] == of), here - 1, first)
    itself = here == first
    wanted = ~itself | referred[row]
    source_row, source = row[before][wanted], edge[before][wanted]
    row, edge, itself = row[wanted], edge[wanted], itself[wanted]
    order = np.lexsort((edge, row))
    row, edge, itself, source, source_row = row[order], edge[order], itself[order], source[order], source_row[order]
    source_rank = rank[doc[source_row]]

    def joined(which: np.ndarray, kind: int) -> list[np.ndarray]:
        r, e, s, at = row[which], edge[which], source[which], source_rank[which]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (e[1:] != e[:-1] + 1) | (s[1:] != s[:-1] + 1) | (at[1:] != at[:-1])
        head = np.flatnonzero(new)
        own, other = ids[doc[r[head]]], ids[doc[source_row[which][head]]]
        n = np.diff(head, append=len(r))
        return [np.full(len(head), kind), own[:, 0], own[:, 1], start[r[head]], e[head], n, other[:, 0], other[:, 1], s[head]]

    both = zip(joined(~itself, PATH), joined(referred[row], REFERRED), strict=True)
    return batch_of(PATHS_ARROW, [np.concatenate(x).astype(np.int32 if f.type == pa.int32() else np.int64) for x, f in zip(both, PATHS_ARROW, strict=True)])


def _resolved(dealt: DataFrame) -> DataFrame:
    """PATHS of sorted rows of DEALT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        bucket = None
        for batch in batches:
            for at, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == OCCURRENCES:
                    doc, key, start, edges, source, source_key, source_start = unpack(data, REFERRING)
                    yield batch_of(PATHS_ARROW, [np.full(len(doc), REFERENCE, np.int32), doc, key, start, start, edges.astype(np.int32), source, source_key, source_start])
                    continue
                if at != bucket:
                    if held:
                        yield _paths_in(held)
                    held, bucket = [], at
                held.append(data)
        if held:
            yield _paths_in(held)

    return dealt.mapInArrow(run, PATHS)


def _followed(found: DataFrame) -> DataFrame:
    """All documents' paths: their own, and those of the rows that they refer to."""
    place = ("doc_id", TEXT_KEY, "start", "windows", "source_doc", "source_key", "source_start")
    referred = found.where(F.col("kind") == REFERRED).select(
        F.col("doc_id").alias("source_doc"), F.col(TEXT_KEY).alias("source_key"), F.col("row").alias("source_start"), (F.col("start") - F.col("row")).alias("offset"),
        F.col("windows").alias("n"), F.struct("source_doc", "source_key", "source_start").alias("source"),
    ).dropDuplicates(["source_doc", "source_key", "source_start", "offset"])
    references = found.where(F.col("kind") == REFERENCE).join(referred, ["source_doc", "source_key", "source_start"])
    followed = references.select("doc_id", TEXT_KEY, (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("windows"), "source.*")
    return found.where(F.col("kind") == PATH).select(*place).unionByName(followed.select(*place))


def _compacted(paths: DataFrame) -> DataFrame:
    """Maximal paths: those that go on, in document and source alike, at the vertex where another one ends."""
    # Rows that are there twice give the same paths; one of each start is enough.
    rest = [c for c in paths.columns if c not in ("doc_id", TEXT_KEY, "start")]
    paths = paths.repartition("doc_id", TEXT_KEY).groupBy("doc_id", TEXT_KEY, "start").agg(F.max_by(F.struct(*rest), F.struct("windows", "source_doc", "source_start")).alias("s")).select("doc_id", TEXT_KEY, "start", "s.*")
    in_order = Window.partitionBy("doc_id", TEXT_KEY).orderBy("start")
    before = F.lag(F.struct(F.expr("start + windows AS stop"), "source_doc", "source_key", F.expr("source_start + windows AS source_stop"))).over(in_order)
    goes_on = F.struct(F.col("start").alias("stop"), "source_doc", "source_key", F.col("source_start").alias("source_stop")) == F.col("before")
    path = F.sum(F.when(goes_on, 0).otherwise(1)).over(in_order)
    return (
        paths.withColumn("before", before)
        .withColumn("path", path)
        .groupBy("doc_id", TEXT_KEY, "path")
        .agg(F.min("start").alias("start"), F.sum("windows").cast("int").alias("windows"), F.min_by("source_doc", "start").alias("source_doc"), F.min_by("source_key", "start").alias("source_key"), F.min("source_start").alias("source_start"))
        .drop("path")
    )


def _words_read(stretches: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, start, windows, words (a digest of 16 bytes) of stretches of documents, each once."""
    per_text = stretches.select("doc_id", TEXT_KEY, "start", "windows").distinct().groupBy("doc_id", TEXT_KEY).agg(F.collect_list(F.struct("start", "windows")).alias("stretches"))
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                rows = []
                for r in part.to_pylist():
                    words = r["text"].encode().split()
                    for s in r["stretches"]:
                        stretch = b" ".join(words[s["start"] : s["start"] + s["windows"] + length - 1])
                        rows.append((r["doc_id"], r[TEXT_KEY], s["start"], s["windows"], hashlib.blake2b(stretch, digest_size=16).digest()))
                yield batch_of(arrow, [[x[i] for x in rows] for i in range(len(arrow))])

    joined = per_text.join(keyed_texts(docs), ["doc_id", TEXT_KEY]).select("doc_id", TEXT_KEY, "stretches", "text")
    return joined.mapInArrow(run, f"doc_id long, {TEXT_KEY} long, start int, windows int, words binary").dropDuplicates(["doc_id", TEXT_KEY, "start", "windows"])


def _compared(paths: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """paths with words, and source_words at their source."""
    source = paths.select(F.col("source_doc").alias("doc_id"), F.col("source_key").alias(TEXT_KEY), F.col("source_start").alias("start"), "windows")
    read = checkpointed(_words_read(paths.select("doc_id", TEXT_KEY, "start", "windows").unionByName(source), docs, length))
    at_source = read.select(F.col("doc_id").alias("source_doc"), F.col(TEXT_KEY).alias("source_key"), F.col("start").alias("source_start"), "windows", F.col("words").alias("source_words"))
    return paths.join(read, ["doc_id", TEXT_KEY, "start", "windows"]).join(at_source, ["source_doc", "source_key", "source_start", "windows"])


def _verified(paths: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The paths whose words are the same at their source; of others, the windows that are repeated nevertheless."""
    names = paths.columns
    compared = checkpointed(_compared(paths, docs, length))
    good, bad = compared.where("words = source_words").select(names), compared.where("words <> source_words").select(names)
    if bad.isEmpty():
        return good
    offset = F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("offset")
    single = bad.select("*", offset).withColumns({"start": F.col("start") + F.col("offset"), "source_start": F.col("source_start") + F.col("offset"), "windows": F.lit(1)}).select(names)
    windows = checkpointed(_compared(single, docs, length))
    # Of windows with one hash, the first with certain words is such a window itself or the source of one.
    failed = windows.where("words <> source_words")
    known = failed.select("words", "doc_id", TEXT_KEY, "start").unionByName(failed.select(F.col("source_words").alias("words"), F.col("source_doc").alias("doc_id"), F.col("source_key").alias(TEXT_KEY), F.col("source_start").alias("start")))
    first = known.groupBy("words").agg(F.min(F.struct("doc_id", TEXT_KEY, "start")).alias("first"))
    place = F.struct("doc_id", TEXT_KEY, "start")
    others = failed.join(first, "words").where(F.col("first") != place)
    others = others.select("doc_id", TEXT_KEY, "start", "windows", F.col("first.doc_id").alias("source_doc"), F.col(f"first.{TEXT_KEY}").alias("source_key"), F.col("first.start").alias("source_start"))
    return good.unionByName(windows.where("words = source_words").select(names)).unionByName(others.select(names))


def repeated_paths(docs: DataFrame, length: int = 20, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_key, start, windows, source_doc, source_key, source_start.

    A path stands for windows + length - 1 words from word ``start`` on, which also stand at the source: in a
    document with a smaller doc_id, or earlier in the same document. Sources are first occurrences over the whole
    table, or the one before in the same document, so a passage is one path of a document however the table is dealt. Rows without doc_id have no paths; rows
    that share a doc_id but not a text count as documents ordered by their texts' hashes, repeated rows as one.
    hash_bits: of words; with fewer, more windows collide and are told apart by their words.
    """
    found = checkpointed(_resolved(dealt_in_passes(_dealt(docs, length, hash_bits), passes(docs), _split)))
    return _verified(checkpointed(_compacted(_followed(found))), docs, length)


def remove_repeated_words(docs: DataFrame, length: int = 20, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept (string), kept_sha256 per row of docs.

    A word (bytes other than ASCII white space) goes if a path covers it. Null texts and texts without words keep
    nothing; texts of any length are compared whole; the kept words are joined by one space. An empty table gives no
    rows; other columns of docs take no part, whatever their names.
    """
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def row(doc_id: int, key: int, data: bytes, spans: np.ndarray) -> tuple:
        words = data.split()
        kept, gone = words, 0
        if len(spans):
            covered = removed_tokens(spans, len(words), length).tolist()
            kept = [w for w, c in zip(words, covered, strict=True) if not c]
            gone = len(words) - len(kept)
        joined = b" ".join(kept)
        return doc_id, key, len(words), gone, joined.decode(), hashlib.sha256(joined).hexdigest()

    spans = repeated_paths(docs, length, hash_bits).select("doc_id", TEXT_KEY, F.shiftleft(F.col("start").cast("long"), SPAN_BITS).bitwiseOR(F.col("windows").cast("long")).alias("span"))
    return rewritten(docs, spans, row, arrow, f"doc_id long, {TEXT_KEY} long, n_words long, n_removed long, kept string, kept_sha256 string")
