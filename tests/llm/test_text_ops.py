"""Decontamination, language, quality, licences and packing on small and awkward tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from fixtures import crc, frame, sentence, sha

from trialloom.llm import decontam, langid, licenses, packing, quality
from trialloom.llm.queries import tokenizer_path


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def leaks(rows, items, size=10):
    out = {}
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i:i + n])].add(str(item))
    for doc, text in rows:
        w, hit, named = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                found = grams.get(tuple(w[i:i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    named |= found
        out[doc] = (len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit))
    return out


def benchmark_rows():
    rng = random.Random(5)
    items = [(i, sentence(rng, 14)) for i in range(12)]
    return items + [(20, "Short Item here"), (21, "w1"), (22, ""), (23, None), (24, items[0][1]), (25, "Été à l'Île " + sentence(rng, 9))]


def leaky_rows():
    rng, items = random.Random(6), dict(benchmark_rows())
    rows = [(i, sentence(rng, 40)) for i in range(30)]
    rows += [(40, f"Start. {items[3].upper()} end"), (41, items[0].replace(" ", " -- ")), (42, " ".join(items[5].split()[:9])),
             (43, " ".join(items[5].split()[:10])), (44, "a SHORT, item: here short item here b"), (45, items[25]), (46, None), (47, ""), (48, "--"),
             (49, (items[7] + " ") * 40), (50, items[25].replace("É", "é"))]
    return rows


def contaminated(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_decontamination_matches_brute_force(spark):
    docs, items = frame(spark, leaky_rows()), spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    want = leaks(leaky_rows(), benchmark_rows())
    assert contaminated(decontam.contamination(docs, items)) == want
    # a benchmark over the bound is scanned in blocks, with the same result
    assert contaminated(decontam.contamination(docs, items, broadcast_bytes=3000)) == want
    clean = decontam.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}


def test_decontamination_without_items_or_rows(spark):
    docs, none = frame(spark, [(1, "a b"), (None, "a b"), (1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert sorted(r.n_hit for r in decontam.contamination(docs, none).collect()) == [0, 0, 0]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontam.contamination(docs, items).collect()) == [2, 2, 2]
    assert decontam.contamination(frame(spark, []), items).collect() == []
    assert decontam.keep_clean(docs, items).collect() == []


def test_language_backoff(spark):
    rng = random.Random(7)
    parts = {"aa": ["kro", "mi", "tak", "zul"], "bb": ["sha", "len", "ori", "wae"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make("aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(900, None, "aa"), (901, "text", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    tests = [(i, make("aa" if i % 2 else "bb", 3)) for i in range(60)]
    odd = [(100, None), (101, ""), (102, "12 34 !?"), (103, "——"), (104, "日本"), (105, "kromi " * 30_000)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, tests + odd), model).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und"] * 4 and got[104].lang_pred in ("aa", "bb")
    assert got[105].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    unseen = langid.Scorer(model).backoff([b"kromitakzulkromi", "日本".encode()])
    assert unseen[0, 0] > unseen[0, 1] and (unseen[1] == 0).all()
    docs = frame(spark, tests + odd)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {100, 101, 102, 103}.isdisjoint(r.doc_id for r in kept.collect())
    empty = langid.train(frame(spark, []))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    bounded = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=20, max_words=15)
    assert len(bounded.words) <= 15


def test_language_held_out(spark):
    from trialloom.llm.queries import op9_language_id

    found = op9_language_id(spark, "/root/testdata/sf0.001").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert (found.held_out == [crc(i) % 4 == 2 for i in found.doc_id]).all()
    out = found[found.held_out]
    assert (out.lang_pred.values == truth.loc[out.doc_id].values).mean() >= 0.97


def test_quality_held_out_and_awkward(spark):
    from trialloom.llm.queries import op10_quality_classifier

    sf = "/root/testdata/sf0.01"
    found = op10_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    assert (found.held_out == [crc(i) % 3 == 1 for i in found.doc_id]).all()
    out = found[found.held_out & found.doc_id.isin(labels.index)]
    assert (out.predicted.values == labels.loc[out.doc_id].values).mean() >= 0.95
    none = quality.train(frame(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(frame(spark, [(1, "a"), (None, None), (2, "")]), none).collect()] == [0.5] * 3
    some = quality.train(frame(spark, [(i, "good words " * (i % 5) if i % 2 else "!!!! $$$$") for i in range(50)]),
                         spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None)], "doc_id long, quality int"))
    scores = [r.score for r in quality.score(frame(spark, [(1, None), (2, ""), (3, "x " * 100_000)]), some).collect()]
    assert len(scores) == 3 and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)


def test_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(0)
    rows = rng.random((3000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows, labels)
    assert model.pairs and {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(rows) >= 0.5) == labels).mean() > 0.95


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "the MIT License and the mit  license"), (3, "CC-BY-NC 4.0"),
            (4, "gnu general public licence"), (5, None), (6, ""), (7, "mit license " * 20_000), (8, "apache license apache license"), (None, "all rights reserved"),
            (9, "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].score) == ("apache", "Apache-2.0,apache", 1, 3, 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].n_words) == (2, 1, 5, 7)
    assert got[3].base_labels == "cc-by" and {"CC-BY-NC", "CC-BY-4.0"} <= set(got[3].labels.split(","))
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) for i in (5, 6)] == [(0, 0, None, "", 0.0)] * 2
    assert got[4].labels == "" and got[7].n_base == 20_000 and got[8].n_base == 2 and got[None].labels == "proprietary"
    assert {"GPL-3.0-or-later", "gpl"} <= set(got[9].labels.split(","))
    assert licenses.scan(frame(spark, [])).collect() == []


def test_license_automaton_regions():
    a = licenses.compile_template("x", "begin <<opt>>maybe <<opt>>inner<</opt>> this<</opt>> middle <<any 2>> end")
    accepts = lambda text: a.accept(licenses.words_of(text), 0)
    assert accepts("begin middle end") == 3 and accepts("begin maybe this middle end") == 5 and accepts("begin maybe inner this middle x y end") == 8
    assert accepts("begin maybe middle end") is None and accepts("begin middle x y z end") is None and accepts("begin middle") is None


def slow_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fit:
            rooms[min(fit)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def check_places(places, capacity):
    by_sequence = defaultdict(list)
    for sequence, offset, length in places:
        by_sequence[sequence].append((offset, length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([4, 10, 64, 2048])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        counts = defaultdict(int)
        for length in lengths:
            counts[length] += 1
        runs = packing.plan(counts, capacity)
        ranks = defaultdict(list)
        places = []
        for r in runs:
            for i in range(r.count):
                ranks[r.length].append(r.first + i)
                places.append((r.sequence + i // r.each, r.offset + i % r.each * r.length, r.length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
        assert check_places(places, capacity) == slow_best_fit(lengths, capacity)
        assert len(runs) <= 4 * capacity + 4


def test_chunked_ids_are_those_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole, rng = Tokenizer.from_file(path), random.Random(9)
    rows = ["", " ", None, "It's Á é x y　z ́abc <|endoftext|> Q<|endoftext|>R ﬁ İstanbul ΑΣ ΑΣ. don'T 12 3４5 日本語 a\x0bb \x1cA a Ab aB",
            "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(3000)), "aB Ab ab AB " * 3000, "x" * 50_000]
    want = [whole.encode(text or "", add_special_tokens=False).ids + [0] for text in rows]
    ids, bounds = packing.Encoder(path).encode(pa.array(rows, pa.string()), 0)
    assert [ids[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == want
    monkeypatch.setattr(packing, "_CACHE", 10)  # a cache that is always full
    small = packing.Encoder(path)
    for text, one in [*zip(rows, want), *zip(rows, want)]:
        assert small.encode(pa.array([text], pa.string()), 0)[0].tolist() == one


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    rows = [(i, "the same length" if i % 3 else sentence(rng, rng.randint(0, 90))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "no id"), (502, sentence(rng, 3000)), (3, "repeated id")]
    capacity = 256
    got = packing.pack(frame(spark, rows), tokenizer_path(), capacity, keep_ids=True).collect()
    n = check_places([(r.sequence_id, r.offset, r.length) for r in got], capacity)
    total = sum(r.length for r in got)
    assert n <= -(-total // capacity) + 2
    whole = Tokenizer.from_file(tokenizer_path())
    want = sorted(str(whole.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows if i != 3)
    parts = defaultdict(dict)
    for r in got:
        if r.doc_id != 3:
            parts[r.doc_id][r.start] = r.ids
    assert sorted(str([x for s in sorted(p) for x in p[s]]) for p in parts.values()) == want
    assert packing.pack(frame(spark, []), tokenizer_path()).collect() == []


def test_language_stage_keeps_short_and_mixed_texts(spark):
    import corpus_pipeline

    rng = random.Random(8)
    tongues = {f"l{k}": [f"{a}{b}{k_}" for a in "bdfgk" for b in "aeiou" for k_ in "lmnrst"[k]] for k in range(6)}
    rows = [(4 * i, " ".join(rng.choice(tongues[lang]) for _ in range(30)), lang) for i, lang in enumerate(sorted(tongues) * 8)]
    odd = [(1002, "qq", None), (1006, "qqq xx", None), (1010, " ".join(tongues[t][3] for t in sorted(tongues)), None),
           (1014, tongues["l0"][0] + " " + tongues["l1"][0], None), (1018, "12 34 ...", None), (1022, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows} | {1002, 1006, 1010, 1014}
