"""The filter audit against a loop over all orders; tries and prefix ranges on their own."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from fixtures import sentence

from trialloom.llm import filteraudit


def brute(rows, labels):
    """rows: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
        fails += ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "") + ("D" if re.search("[#$%&*|]", t) else "")
        fails += "E" if i is not None and min(texts[t]) < i else ""
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == f for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows_and_labels(seed=3):
    rng = random.Random(seed)
    head = "Shared head of many pages, longer than any first prefix. " * 40
    texts = [sentence(rng, rng.choice([5, 150, 250])) for _ in range(60)] + [head + sentence(rng, 30) for _ in range(40)]
    texts += ["x " * 300, "ABC def " * 150, "50 % off & more " + sentence(rng, 220), "", None, "é", "É", "e f " * 210, head, head[:64], head[:4]]
    texts += [rng.choice(texts) for _ in range(60)] + ["one copied text"] * 150
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    rows += [(5, rows[5][1], "en"), (5, "another text of one id", "en"), (None, "one copied text", "fr"), (None, None, None)]
    rows.append((9999, sentence(rng, 40_000), "de"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, len(rows), 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("part", "mask", "own", "digest", "key", "least", "n", "good", "toxic", "quality", "step"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(""))


@pytest.mark.parametrize("limit,trie", [(None, 32 << 20), (3000, 32 << 20), (600, 5000)])
def test_matches_a_loop_over_all_orders(spark, monkeypatch, limit, trie):
    monkeypatch.setattr(filteraudit, "TRIE_BYTES", trie)
    rows, labels = rows_and_labels()
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filteraudit.audit(*frames(spark, rows, labels), limit).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    rows, labels = rows_and_labels()
    assert filteraudit.audit(*frames(spark, [], labels)).collect() == []
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filteraudit.audit(*frames(spark, rows, [])).collect()}
    assert got == brute(rows, [])


def test_tries_hold_the_least_id_of_every_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(12))).encode() for _ in range(3000)] + [b"a" * 5000, b"a" * 4999 + b"b"]
    least, trie, size = {}, filteraudit.Trie(), 0
    for i in rng.sample(range(len(texts)), len(texts)):
        size += trie.insert(texts[i], i)
        least[texts[i]] = min(i, least.get(texts[i], i))
    assert list(trie.terminals()) == sorted(least.items())
    assert size <= sum(map(len, least))


def test_heavy_prefixes_are_split_until_every_key_is_light(spark):
    rows, labels = rows_and_labels()
    docs, _ = frames(spark, rows, labels)
    tree = filteraudit.prefix_tree(docs, 3000)
    assert tree.deepest > 64 and tree.heavy  # the shared head is longer than the first rounds look
    sizes = defaultdict(int)
    kinds = defaultdict(set)
    for _, t, _ in rows:
        key, at = tree.place((t or "").encode())
        assert 0 <= at <= 1
        sizes[key] += len((t or "").encode()) + filteraudit.ROW_BYTES
        kinds[key].add(t or "")
    assert all(size <= 3000 or len(kinds[key]) == 1 for key, size in sizes.items())
