"""Notices, their spans and labels; base columns against a plain count."""

import random
import re

import pytest

from volmesh.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person\n     obtaining a copy of this software and associated files"


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MPL License", []), ("Released under the MIT Licence", ["mit"]), ("permit license", []),
        ("licensed under CC BY-SA 4.0", ["cc-by-sa"]), ("Licensed under CC BY-ND 4.0", ["cc-by-nd"]), ("licensed under cc by 4.0", ["cc-by"]), ("Licenced under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]),
        (MIT, ["mit"]), (MIT.replace("\n     ", "\n// * "), ["mit"]), (MIT.replace("hereby", "herebi").replace("charge", "charg"), ["mit"]),
        ("under the terms of the GNU Lesser General Public License", ["lgpl"]), ("under the terms of the GNU\n# General Public License", ["gpl"]),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted", ["bsd"]), ("", []), ("nothing here", []),
    ],
)
def test_labels(text, labels):
    spans = licenses.fuzzy_spans(text.lower(), licenses.NOTICES)
    assert [s[0] for s in spans] == labels


def test_spans_are_places_of_the_text():
    text = "intro  text\n\n * Released   under\n * the MIT License. Released under the MIT Licence"
    spans = licenses.fuzzy_spans(text.lower(), licenses.NOTICES)
    assert [text[a:b] for _, a, b, _ in spans] == ["Released   under\n * the MIT License", "Released under the MIT Licence"]
    assert [e for *_, e in spans] == [0, 1]


def test_every_notice_is_found_with_edits():
    rng = random.Random(5)
    for text, label in licenses.NOTICES:
        parts = re.split("[{}]", text)
        k = rng.randrange(1, len(parts[0]) - 1)
        edited = parts[0][:k] + "~" + parts[0][k + 1 :] + "".join(parts[1:])
        assert label in {s[0] for s in licenses.fuzzy_spans(f"before {edited} after", licenses.NOTICES)}, text


def test_base_columns_and_edges(spark):
    rng = random.Random(3)
    pieces = ["MIT License", "mit\nlicense", "Apache License", "general public license", "General Public", "license", "MITlicense", "x", "é日", "--", "mit-license", "mit license apache license"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(80)] + [(80, None), (81, ""), (None, "mit license"), (82, "w " * 200_000 + "MIT License"), (3, "mit license"), (3, "mit license")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, sorted({label for _, label in at})))
    assert got == sorted(want, key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0
