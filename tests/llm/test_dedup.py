"""Near-dedup and line dedup against brute force; hot groups, chains and awkward rows."""

import re

import numpy as np
import pytest
from fixtures import frame, texts

from trialloom.llm import linededup, setsketch


def shingles(text, k):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", folded) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def groups(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_match_brute_force(spark, k, num, den):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(frame(spark, rows), k, num, den).collect()}
    assert got == groups(rows, k, num, den)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    rows = texts(2)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(frame(spark, rows), 3, 85, 100).collect()}
    assert got == {i: c for i, (_, c) in groups(rows, 3, 85, 100).items()}


def family(n):
    """Copies of one text with one to three words replaced, and as many with so many that they are linked with nothing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in range(150)]
        for place in rng.choice(148, int(rng.integers(1, 4)) if i % 2 else 9, replace=False):
            words[place + 1] = f"own{i}x{place}"
        rows.append((i, " ".join(words)))
    return rows


def test_members_that_stay_apart_are_not_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    counts = []

    def counted(rows, *extra, dealt=setsketch._dealt):
        out = dealt(rows, *extra)
        if "items" in extra:
            counts.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(setsketch, "_dealt", counted)
    for n in (200, 400):
        rows = family(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(frame(spark, rows), 3, 85, 100).collect()}
        assert got == groups(rows, 3, 85, 100)
        assert len({c for _, c in got.values()}) > n // 3
    assert all(dealt <= 3 * max(members, n // 4) for (members, dealt), n in zip(counts, (200, 400)))


def test_lone_items_are_held_by_one_set(spark):
    sets = {1: [1, 2, 3], 2: [3, 4, 5], 3: [5, 3], 4: [9]}
    rows = [(node, np.array(items, np.uint64).tobytes()) for node, items in sets.items()]
    lone = setsketch._lone(spark.createDataFrame(rows, "node long, items binary"))
    assert {r.node: r.lone for r in lone.collect()} == {1: 2, 2: 1, 4: 1}


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (None, "lonely words here now"), (7, None), (8, "")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in setsketch.near_duplicates(frame(spark, rows), 5).collect())
    assert got == sorted([("5", "3", False), ("5", "3", False), ("3", "3", True), ("None", "3", False), ("None", "None", True),
                          ("7", "7", True), ("8", "8", True)])
    assert setsketch.near_duplicates(frame(spark, []), 5).collect() == []


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = frame(spark, texts(3))
    kept = setsketch.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in groups(texts(3), 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_registers_merge_and_follow_the_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b[:600] = a[:600]
    merged = np.maximum(setsketch.registers(a, 512), setsketch.registers(b, 512))
    assert (merged == setsketch.registers(np.union1d(a, b), 512)).all()
    assert abs((setsketch.registers(a, 512) == setsketch.registers(b, 512)).mean() - 0.5) < 0.1
    bands, width = setsketch.banding(0.85)
    assert (1 - 0.85 ** width) ** bands <= setsketch.MISS


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 299), (299, 301)]
    got = {r.node: r.root for r in setsketch.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(80)}, 299: 299, 300: 299, 301: 299}


def brute_lines(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p:p + 3])
            if not any(re.search(r"\S", w) for w in window):
                continue
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        kept = [w for p, w in enumerate(lines) if p not in gone]
        out.append((i, "\n".join(kept), len(lines), len(gone)))
    return out


def line_rows():
    passage = "\n".join(f"shared line {i} of the passage" for i in range(5))
    rows = [(i, f"own {i}\n{passage}\nown end {i}") for i in range(80)]
    rows += [(100, "x\ny\nz\nx\ny\nz\nx\ny\nz\nq"), (101, "\n\n\n\n\n"), (102, ""), (103, None), (104, "one line"), (105, "a\nb"),
             (106, "x\ny\nz"), (107, "shared line 0 of the passage\nshared line 1 of the passage"), (108, "tail\n"),
             (109, "\n".join(f"long {i % 700}" for i in range(4000))), (110, "é\nß\n日本\né\nß\n日本")]
    return rows


def test_line_dedup_matches_brute_force(spark):
    out = linededup.dedup_lines(frame(spark, line_rows()))
    got = sorted((r.doc_id, r.text, r._lines, r._removed) for r in out.select("doc_id", "text", "_lines", "_removed").collect())
    assert got == brute_lines(line_rows())
    spans = {r.doc_id: [(s.line, s.n) for s in r._spans] for r in out.collect()}
    assert spans[1] == [(1, 5)] and spans[0] == [] and spans[100] == [(3, 6)]


def test_line_dedup_rows_without_or_with_equal_ids(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "k\nl\nm"), (2, "k\nl\nm"), (3, "k\nl\nm\nn")]
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    assert got == [("1", ""), ("2", "k\nl\nm"), ("2", "k\nl\nm"), ("3", "n"), ("None", "a\nb\nc")]
    kept = linededup.keep_unrepeated(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    assert kept.columns == frame(spark, rows).columns
    assert linededup.dedup_lines(frame(spark, [])).collect() == []
