"""Templates against plain regular expressions, altered licences, identifiers and base phrases by brute force."""

import random
import re

import pytest

from trialloom.llm import licenses

SF_DIR = "/root/testdata/sf0.001"
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def plain_words(text):
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_pattern(markup):
    """A template as a backtracking pattern over blank-joined words, each followed by a blank."""
    out = ""
    for piece in re.split(r"(<<[^>]*>>)", markup):
        if piece == "<<opt>>":
            out += "(?:"
        elif piece == "<</opt>>":
            out += ")?"
        elif piece.startswith("<<any"):
            out += r"(?:\S+ ){0,%d}" % int(piece[6:-2])
        else:
            out += "".join(re.escape(w) + " " for w in plain_words(piece))
    return re.compile(out)


def plain_scan(text):
    words = plain_words(text)
    joined = "".join(w + " " for w in words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    number = {at: i for i, at in enumerate(starts)}
    base = [(number[m.start()], label) for phrase, label in licenses.BASE_PHRASES
            for m in re.finditer(f"(?<![^ ])(?={re.escape(phrase)} )", joined)]
    spans = set()
    for label, markup in licenses.TEMPLATES:
        pattern = plain_pattern(markup)
        for i, at in enumerate(starts[:-1]):
            if pattern.match(joined, at):
                made = licenses.compile_template(label, markup)
                spans.add((made.label, made.kind, i))
    return len(words), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), \
        ",".join(sorted({b[1] for b in base})), spans


def filled(markup, rng, optional=True):
    """A text that the template describes, in mixed case and with punctuation."""
    out = []
    for piece in re.split(r"(<<opt>>.*?<</opt>>|<<any \d+>>)", markup, flags=re.S):
        if piece.startswith("<<any"):
            out += [f"name{i}" for i in range(rng.randrange(int(piece[6:-2]) + 1))]
        elif piece.startswith("<<opt"):
            out += re.sub(r"<<any \d+>>", "", piece[7:-8]).split() if optional and rng.random() < 0.5 else []
        else:
            out += piece.split()
    return " ".join(w + rng.choice(["", "", ",", "."]) if rng.random() < 0.3 else w.upper() if rng.random() < 0.2 else w for w in out)


def sample_texts():
    rng = random.Random(12)
    texts = [None, "", "mit license", "The MIT License", "GNU general public license", "cc by cc by-nc", "licensed under the", "GPLv3 or AGPLv3"]
    for _, markup in licenses.TEMPLATES:
        whole = filled(markup, rng)
        words = whole.split()
        drop = rng.randrange(len(words))
        texts += [f"before {whole} after", " ".join(words[:drop] + words[drop + 1:]), " ".join(words[:-1])]
    return texts


def test_scanner_equals_plain_patterns():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    for text in sample_texts():
        got = scanner.scan((text or "").encode())
        want = plain_scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == want[:5], text
        assert {(s["label"], s["kind"], s["first_word"]) for s in got["spans"]} == want[5], text
        assert got["score"] == (1.0 if want[5] else 0.5 if want[1] else 0.0)


def test_base_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(texts[r.doc_id])[:5]


@pytest.mark.parametrize("label", [la for la, _ in licenses.TEMPLATES if la.endswith(("-text", "-header"))])
def test_altered_last_clauses_are_rejected(label):
    markup = dict(licenses.TEMPLATES)[label]
    scanner = licenses.Scanner([], [(label, markup)])
    words = filled(markup, random.Random(3)).split()
    assert scanner.scan(" ".join(words).encode())["labels"] == label
    for altered in (words[:-1], [*words[:-1], "otherwise"], [*words[:-4], "not", *words[-4:]]):
        assert scanner.scan(" ".join(altered).encode())["score"] == 0.0


def test_identifiers_and_short_forms():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    found = lambda text: {(s["label"], s["kind"]) for s in scanner.scan(text.encode())["spans"]}
    assert found("// SPDX-License-Identifier: MIT") == {("MIT", "identifier")}
    assert ("GPL-3.0-or-later", "identifier") in found("SPDX-License-Identifier: GPL-3.0-or-later")
    assert found("released as GPLv3") == found("GNU General Public License v3.0") == {("GPL-3.0", "notice")}
