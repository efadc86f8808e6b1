"""Licence scans: exact phrases, and short notices found with a bounded number of edits.

A notice that may differ in e edits is cut into e + 1 pieces; whatever lies within e edits holds one of them
unchanged. One automaton finds those exact seeds, they locate candidates, and the regex library's bounded-error
matching verifies the stretch around each, counts its edits and gives its span. How lines are wrapped and commented
makes no difference; the words that tell licences apart allow no edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TEXT_KEY, batch_of, column, keyed_texts, slices

#: Phrases of consecutive words and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices and their labels (fixed values, in lower case and with single spaces). What stands in braces tells
#: one licence from another and allows no edits.
NOTICES = (
    ("permission is hereby granted, free of charge, to any person {obtaining a copy} of this software", "mit"),
    ("released under the {mit} license", "mit"),
    ("licensed under the {mit} license", "mit"),
    ("licensed under the {apache} license, version 2.0", "apache"),
    ("licensed under the gnu {general} public license", "gpl"),
    ("under the terms of the gnu {general} public license", "gpl"),
    ("licensed under the gnu {lesser} general public license", "lgpl"),
    ("under the terms of the gnu {lesser} general public license", "lgpl"),
    ("licensed under the gnu {affero} general public license", "agpl"),
    ("under the terms of the gnu {affero} general public license", "agpl"),
    ("redistribution and use in {source and binary} forms, with or without modification, are permitted", "bsd"),
    ("licensed under the {bsd} license", "bsd"),
    ("permission to use, copy, modify, and/or {distribute this software} for any purpose", "isc"),
    ("permission to use, copy, modify, and {distribute this software} for any purpose", "isc"),
    ("subject to the terms of the {mozilla} public license", "mpl"),
    ("made available under the terms of the {eclipse} public license", "epl"),
    ("distributed under the {boost} software license, version 1.0", "bsl"),
    ("free and unencumbered software released into the {public domain}", "unlicense"),
    ("licensed under {cc0} 1.0 universal", "cc0"),
    ("licensed under cc {by} 4.0", "cc-by"),
    ("licensed under cc {by-sa} 4.0", "cc-by-sa"),
    ("licensed under cc {by-nc} 4.0", "cc-by-nc"),
    ("licensed under cc {by-nd} 4.0", "cc-by-nd"),
    ("licensed under cc {by-nc-sa} 4.0", "cc-by-nc-sa"),
    ("licensed under cc {by-nc-nd} 4.0", "cc-by-nc-nd"),
    ("creative commons {attribution} 4.0 international", "cc-by"),
    ("creative commons {attribution-sharealike} 4.0 international", "cc-by-sa"),
    ("creative commons {attribution-noncommercial} 4.0 international", "cc-by-nc"),
    ("creative commons {attribution-noderivatives} 4.0 international", "cc-by-nd"),
)
#: One edit is allowed for so many characters of a notice, before and after what has to be exact.
CHARS_AN_EDIT = 12
#: White space counts as one space; after a line's end, so do marks that begin a comment's line.
GAP = re.compile(r"[ \t\r\x0b\x0c]*\n(?:[\s]|//+|/?\*+/?|#+|;+|%+|--+|>+)*|[ \t\r\x0b\x0c]+")

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_WORD = rb"[0-9a-z\x80-\xff]"


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    pattern: regex.Pattern


def notice(text: str, label: str) -> Notice:
    parts = re.split(r"[{}]", text)
    allowed = [0 if i % 2 or len(p) < 6 else max(1, len(p) // CHARS_AN_EDIT) for i, p in enumerate(parts)]
    exact = lambda p: f"(?<![0-9a-z-]){regex.escape(p, literal_spaces=True)}(?![0-9a-z-])"
    fuzzy = lambda p, e: f"(?:{regex.escape(p, literal_spaces=True)}){{e<={e}}}" if e else regex.escape(p, literal_spaces=True)
    pattern = "".join(exact(p) if i % 2 else fuzzy(p, e) for i, (p, e) in enumerate(zip(parts, allowed, strict=True)))
    return Notice("".join(parts), label, sum(allowed), regex.compile(f"(?b){pattern}"))


_notices: dict[tuple, tuple[list[Notice], ahocorasick.Automaton]] = {}


def compiled(notices: tuple) -> tuple[list[Notice], ahocorasick.Automaton]:
    """The notices, and an automaton of their seeds: to each its length, notices and offsets in them."""
    if notices not in _notices:
        own, seeds = [notice(*n) for n in notices], {}
        for i, n in enumerate(own):
            cuts = [round(k * len(n.text) / (n.edits + 1)) for k in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(n.text[a:b], []).append((i, a))
        automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            automaton.add_word(seed, (len(seed), places))
        automaton.make_automaton()
        _notices[notices] = own, automaton
    return _notices[notices]


def _offsets(low: str) -> np.ndarray:
    """Of each character that GAP leaves, and of the end, where it stands in ``low``."""
    out, at = [], 0
    for gap in GAP.finditer(low):
        out += range(at, gap.start() + 1)
        at = gap.end()
    return np.array([*out, *range(at, len(low) + 1)])


def fuzzy_spans(low: str, notices: tuple) -> list[tuple[str, int, int, int]]:
    """(label, start, stop, edits) of notices in a text in lower case, by characters of the text; of notices that
    overlap, the one with the fewest edits for its length."""
    own, automaton = compiled(notices)
    plain = GAP.sub(" ", low)
    places: dict[int, set[int]] = {}
    for end, (size, seeds) in automaton.iter(plain):
        for i, offset in seeds:
            places.setdefault(i, set()).add(end + 1 - size - offset)
    found = []
    for i, starts in places.items():
        n, done = own[i], -1
        for place in sorted(starts):
            if place <= done:
                continue
            start, stop = max(0, place - n.edits), place + len(n.text) + 2 * n.edits
            if m := n.pattern.search(plain, start, stop):
                found.append((sum(m.fuzzy_counts) / len(n.text), -len(n.text), m.start(), m.end(), n.label, sum(m.fuzzy_counts)))
                done = m.end() - 1 - n.edits
    if not found:
        return []
    at, kept = _offsets(low), []
    for _, _, start, stop, label, edits in sorted(found):
        if all(stop <= a or start >= b for a, b, *_ in kept):
            kept.append((start, stop, label, edits))
    return [(label, int(at[a]), int(at[b - 1]) + 1, edits) for a, b, label, edits in sorted(kept)]


def _phrase_pattern(phrases: tuple) -> re.Pattern:
    gap = rb"[^0-9a-z\x80-\xff]+"
    return re.compile(b"(?<!%s)(?:%s)(?!%s)" % (_WORD, b"|".join(b"(" + gap.join(map(re.escape, p.encode().split())) + b")" for p, _ in phrases), _WORD))


def scan_text(text: str, phrases: tuple, notices: tuple, pattern: re.Pattern) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, spans."""
    data = text.encode().lower()
    inside = _IN_WORD[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(inside) else np.zeros(0, int)
    places, base, at = [], set(), 0
    # Places may overlap (a phrase that begins with another's last word), so each search starts one further.
    while m := pattern.search(data, at):
        for i, (phrase, label) in enumerate(phrases):
            if m.group(i + 1) is not None:
                places.append(int(np.searchsorted(starts, m.start())))
                base.add(label)
        at = m.start() + 1
    spans = fuzzy_spans(data.decode(), notices)
    score = 1.0 if base else max((1 - edits / max(1, stop - start) for _, start, stop, edits in spans), default=0.0)
    return len(starts), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | {s[0] for s in spans}), max(0.0, score), spans


SCHEMA = f"doc_id long, {TEXT_KEY} long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:int,stop:int,edits:int>>"


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Per row of docs: n_words, n_base (places of phrases), first_word and last_word (their least and largest
    start in words), base_labels, labels (the notices' as well), score (1 for a phrase, else the best notice's
    share of unchanged characters, else 0), spans (notices: label, start and stop in characters, edits).

    Null texts are empty and have no words; repeated rows give repeated rows, an empty table none. Texts of any length
    are scanned whole. Other columns of docs take no part, whatever their names. A phrase that is the beginning of
    another at the same place hides behind the one that is listed first; of notices that overlap the closest counts.
    """
    pattern = _phrase_pattern(phrases)
    names = pa.list_(pa.string())
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", names), ("labels", names), ("score", pa.float64()), ("spans", span)])
    keys = ("label", "start", "stop", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [scan_text(t, phrases, notices, pattern) for t in column(batch, "text")]
                yield batch_of(arrow, [batch.column(0), batch.column(2), *([r[i] for r in rows] for i in range(7)), [[dict(zip(keys, s, strict=True)) for s in r[7]] for r in rows]])

    return keyed_texts(docs).mapInArrow(run, SCHEMA)
