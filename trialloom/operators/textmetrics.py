"""Text-generation metrics as corpus jobs over (id, prediction, target).

Pairs are placed by id once; n-grams are unfolded after that, so every count per (id, n, gram) is local.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from trialloom.functions.fixed_values import STOP_WORDS
from trialloom.functions.keys import ring_hash
from trialloom.functions.text import words
from trialloom.functions.vectors import keep_valid, maxsim, unit

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"^[\p{L}\p{N}]+$"


def tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """Space-joined n-grams of a token list."""
    starts = F.sequence(F.lit(1), F.size(items) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))
    return F.when(F.size(items) >= n, grams).otherwise(F.array().cast("array<string>"))


def gram_rows(df: DataFrame, keys: list[str], items: Column, top: int) -> DataFrame:
    """(keys, n, gram), one row per occurrence."""
    def labelled(n: int) -> Column:
        return F.transform(ngrams(items, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    per_n = [labelled(n) for n in range(1, top + 1)]
    return df.select(*keys, F.inline(F.flatten(F.array(*per_n))))


def variant_references(pairs: DataFrame, variants: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, ref, reference): the non-empty variants of the target, or the target itself without any."""
    first = variants.groupBy(key).agg(F.min(F.struct(*columns)).alias("v"))
    found = pairs.join(first, pairs["target"] == first[key], "left")
    options = F.array_compact(F.array(*[F.col(f"v.{c}") for c in columns]))
    refs = F.when(F.size(options) > 0, options).otherwise(F.array("target"))
    return found.select("id", F.posexplode(refs).alias("ref", "reference"))


def clipped_grams(items: list[str], references: list[list[str]], n: int) -> tuple[int, int]:
    """The n-grams of a word list that a reference has, counts clipped by the best reference, and all its n-grams."""
    def grams(words) -> Counter:
        return Counter(zip(*(words[i:] for i in range(n))))

    own, best = grams(items), Counter()
    for ref in references:
        best |= grams(ref)
    return sum((own & best).values()), sum(own.values())


def bleu(predictions: DataFrame, references: DataFrame, top: int = 4) -> DataFrame:
    """(id, bleu1..bleu<top>): sentence scores with several references, counts clipped by the best reference.

    Texts move to their id once; n-grams are counted a row at a time and never become rows.
    """
    refs = references.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref", words(F.col("reference")).alias("w")))).alias("_refs"))
    rows = predictions.select("id", words(F.col("prediction")).alias("_w")).join(refs.hint("merge"), "id", "left")
    held = F.size("_w")
    closest = F.array_min(F.transform("_refs", lambda x: F.struct(
        F.abs(F.size(x["w"]) - held).alias("gap"), x["ref"].alias("ref"), F.size(x["w"]).alias("r"))))
    rows = rows.select("id", F.when(F.col("_refs").isNotNull(), held).alias("p"), closest["r"].alias("r"), "_w",
                       F.transform("_refs", lambda x: x["w"]).alias("_refs"))
    kinds = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, p int, r int", *(f"h{n} long, a{n} long" for n in range(1, top + 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(2 * top)]
            for items, refs in zip(batch.column("_w"), batch.column("_refs")):
                items, refs = items.as_py() or [], [r or [] for r in refs.as_py() or []]
                for n in range(1, top + 1):
                    hit, every = clipped_grams(items, refs, n)
                    columns[2 * n - 2].append(hit if every else None)
                    columns[2 * n - 1].append(every or None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "p", "r")), *(pa.array(c, pa.int64()) for c in columns)],
                ["id", "p", "r", *(f"{c}{n}" for n in range(1, top + 1) for c in "ha")])

    return _bleu_scores(rows.mapInArrow(run, kinds), top)


def _bleu_from_hits(ids: DataFrame, hits: DataFrame, lengths: DataFrame, top: int) -> DataFrame:
    cells = [F.max(F.when(F.col("n") == n, F.col("hit"))).alias(f"h{n}") for n in range(1, top + 1)]
    cells += [F.max(F.when(F.col("n") == n, F.col("all"))).alias(f"a{n}") for n in range(1, top + 1)]
    return _bleu_scores(ids.join(hits.groupBy("id").agg(*cells), "id", "left").join(lengths, "id", "left"), top)


def _bleu_scores(wide: DataFrame, top: int) -> DataFrame:
    """(id, bleu1..bleu<top>) from the lengths p and r, and per n the hits h<n> among all a<n> (null without n-grams)."""
    brevity = F.when(F.coalesce("p", F.lit(0)) == 0, 0.0).when(F.col("p") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("p")))
    out = []
    for k in range(1, top + 1):
        usable = F.coalesce(F.least(*[F.col(f"h{n}") for n in range(1, k + 1)], F.lit(1)) > 0, F.lit(False))
        for n in range(1, k + 1):
            usable = usable & F.col(f"h{n}").isNotNull()
        logs = sum(F.log(F.col(f"h{n}") / F.col(f"a{n}")) for n in range(1, k + 1))
        out.append(F.when(usable, brevity * F.exp(logs / k)).otherwise(0.0).alias(f"bleu{k}"))
    return wide.select("id", *out)


def overlap_counts(pairs: DataFrame, predicted: Column, wanted: Column) -> DataFrame:
    """(id, hits, predicted, wanted): multiset intersection of two token lists per pair."""
    placed = pairs.select("id", predicted.alias("p"), wanted.alias("t")).repartition("id")
    sides = placed.select("id", F.explode(F.concat(
        F.transform("p", lambda x: F.struct(x.alias("x"), F.lit(1).alias("side"))),
        F.transform("t", lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))))).alias("e")).select("id", "e.*")
    counts = sides.groupBy("id", "x").agg(F.sum("side").alias("p"), F.sum(1 - F.col("side")).alias("t"))
    sums = counts.groupBy("id").agg(F.sum(F.least("p", "t")).alias("hits"), F.sum("p").alias("predicted"), F.sum("t").alias("wanted"))
    return pairs.select("id").join(sums, "id", "left").na.fill(0, ["hits", "predicted", "wanted"])


def rouge1(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, fmeasure) on lower-case words."""
    def plain(c: str) -> Column:
        return F.filter(tokens(F.lower(c)), lambda w: w.rlike(r"^[\p{L}\p{N}_]"))

    o = overlap_counts(pairs, plain("prediction"), plain("target"))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(0.0)
    return o.select("id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("fmeasure"))


def content_recall(pairs: DataFrame) -> DataFrame:
    """(id, recall) over alphanumeric words that are no stop words; pairs without any in the target are left out."""
    def content(c: str) -> Column:
        return F.filter(tokens(F.lower(c)), lambda w: w.rlike(WORD) & ~w.isin(STOP_WORDS))

    o = overlap_counts(pairs, content("prediction"), content("target"))
    return o.where("wanted > 0").select("id", (F.col("hits") / F.col("wanted")).alias("recall"))


@F.pandas_udf(IntegerType())
def word_edits(prediction: pd.Series, target: pd.Series) -> pd.Series:
    """Word edit distance of each pair."""
    import numpy as np

    def distance(a: list[str], b: list[str]) -> int:
        codes: dict[str, int] = {}
        x = np.array([codes.setdefault(w, len(codes)) for w in a], dtype=np.int64)
        y = np.array([codes.setdefault(w, len(codes)) for w in b], dtype=np.int64)
        row = np.arange(len(y) + 1)
        for i, w in enumerate(x, 1):
            step = np.empty_like(row)
            step[0] = i
            step[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
            # Insertions: running minimum of (value - position), shifted back.
            row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
        return int(row[-1])

    return pd.Series([distance((p or "").split(), (t or "").split()) for p, t in zip(prediction, target)])


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """One row: total edits over total target words."""
    rows = pairs.select(word_edits("prediction", "target").alias("e"), F.size(words(F.col("target"))).alias("n"))
    return rows.agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), (F.sum("e") / F.sum("n")).alias("wer"))


def distinct_share(pairs: DataFrame, top: int = 2) -> DataFrame:
    """(n, distinct, total, share) of the predictions' n-grams; every gram is counted once before the totals."""
    grams = gram_rows(pairs, [], tokens(F.lower("prediction")), top).groupBy("n", "gram").agg(F.count("*").alias("c"))
    return grams.groupBy("n").agg(F.count("*").alias("distinct"), F.sum("c").alias("total"), (F.count("*") / F.sum("c")).alias("share"))


def head_entropy(pairs: DataFrame) -> DataFrame:
    """One row: entropy (bits) of the first two tokens of the predictions."""
    items = tokens(F.lower("prediction"))
    heads = pairs.select(items.alias("t")).where(F.size("t") >= 2).groupBy(
        F.element_at("t", 1).alias("a"), F.element_at("t", 2).alias("b")).agg(F.count("*").alias("c"))
    # H = log2 N - (1/N) sum c log2 c
    return heads.agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("head_entropy"))


def length_error(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.size(tokens(F.col("prediction"))) - F.size(tokens(F.col("target"))))
    return pairs.agg(F.avg(gap).alias("length_mae"), F.count("*").alias("pairs"))


def greedy_token_f1(df: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, f1): every token matched with its best counterpart (given token vectors)."""
    def ready(tok: str, mask: str) -> Column:
        return F.transform(keep_valid(F.col(tok), F.col(mask)), lambda x: unit(x))

    sides = df.select(key, ready("prediction_tokens", "prediction_mask").alias("p"), ready("target_tokens", "target_mask").alias("t"))
    scored = sides.select(key, maxsim(F.col("p"), F.col("t")).alias("precision"), maxsim(F.col("t"), F.col("p")).alias("recall"))
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def cider(pairs: DataFrame, top: int = 4, sigma: float = 6.0) -> DataFrame:
    """(id, cider): mean over n of the clipped tf-idf cosine of prediction and target, length-penalised, times ten."""
    placed = pairs.select("id", words(F.lower("prediction")).alias("p"), words(F.lower("target")).alias("t")).repartition("id")
    sides = placed.select("id", F.explode(F.array(F.struct(F.col("p").alias("w"), F.lit(1).alias("own")), F.struct(F.col("t").alias("w"), F.lit(0).alias("own")))).alias("s"))
    both = gram_rows(sides.select("id", "s.w", "s.own"), ["id", "own"], F.col("w"), top).groupBy("id", "n", "gram").agg(
        F.sum("own").alias("tp"), F.sum(1 - F.col("own")).alias("tt"))
    df = both.where("tt > 0").groupBy("n", "gram").agg(F.count("*").alias("df"))
    corpus = pairs.agg(F.log(F.count("*").cast("double")).alias("_log")).scalar()
    weighted = both.join(df, ["n", "gram"], "left").withColumn("idf", corpus - F.log(F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double")))
    p, t = F.col("tp") * F.col("idf"), F.col("tt") * F.col("idf")
    sums = weighted.groupBy("id", "n").agg(
        F.sum(F.least(p, t) * t).alias("d"), F.sqrt(F.sum(p * p)).alias("np"), F.sqrt(F.sum(t * t)).alias("nt"))
    lengths = placed.select("id", F.greatest(F.size("p") - 1, F.lit(0)).alias("lp"), F.greatest(F.size("t") - 1, F.lit(0)).alias("lt"))
    cosine = F.when(F.col("np") * F.col("nt") > 0, F.col("d") / (F.col("np") * F.col("nt"))).otherwise(0.0)
    per = sums.withColumn("c", cosine).groupBy("id").agg((F.sum("c") / top).alias("c"))
    gap = (F.col("lp") - F.col("lt")).cast("double")
    return lengths.join(per, "id", "left").select(
        "id", (10.0 * F.coalesce("c", F.lit(0.0)) * F.exp(-gap * gap / (2 * sigma * sigma))).alias("cider"))


def self_bleu(predictions: DataFrame, top: int = 4) -> DataFrame:
    """(id, bleu1..4) of each prediction against all the others, however many they are.

    The best count of a gram among the others is the largest, or the second largest for the holder of the largest.
    """
    items = predictions.select("id", tokens(F.lower("prediction")).alias("w"))
    own = gram_rows(items, ["id"], F.col("w"), top).groupBy("id", "n", "gram").agg(F.count("*").alias("c"))
    lead = own.groupBy("n", "gram").agg(F.max(F.struct("c", "id")).alias("first"))
    rest = own.join(lead, ["n", "gram"]).where(F.col("id") != F.col("first.id")).groupBy("n", "gram").agg(F.max("c").alias("second"))
    limits = own.join(lead, ["n", "gram"]).join(rest, ["n", "gram"], "left").withColumn(
        "m", F.when(F.col("id") == F.col("first.id"), F.coalesce("second", F.lit(0))).otherwise(F.col("first.c")))
    hits = limits.groupBy("id", "n").agg(F.sum(F.least("c", "m")).alias("hit"), F.sum("c").alias("all"))
    sizes = items.select("id", F.size("w").alias("p"))
    # One row per distinct length, which texts bound: the nearest other length is a neighbour, or the same when shared.
    around = Window.partitionBy(F.lit(0)).orderBy("p")
    table = sizes.groupBy("p").agg(F.count("*").alias("k")).withColumns({"lo": F.lag("p").over(around), "hi": F.lead("p").over(around)})
    low_gap, high_gap = F.col("p") - F.col("lo"), F.col("hi") - F.col("p")
    nearest = F.when(F.col("k") > 1, F.col("p")).when(
        F.col("hi").isNull() | (low_gap <= high_gap), F.col("lo")).otherwise(F.col("hi"))
    return _bleu_from_hits(predictions.select("id"), hits, sizes.join(table.select("p", nearest.alias("r")), "p"), top)


def top_keywords(texts: DataFrame, terms: DataFrame, key: str, count: int = 3) -> DataFrame:
    """(key, keyword_1..count): the words nearest to the text by given vectors, padded with the empty string.

    texts: key, text, vector. terms: word, vector. Stop words and words without a vector are no candidates.
    """
    from trialloom.functions import vectors

    candidates = texts.select(key, F.explode(F.array_distinct(F.filter(
        tokens(F.lower("text")), lambda w: w.rlike(WORD) & ~w.isin(STOP_WORDS)))).alias("word"))
    ready = terms.select("word", vectors.unit(F.col("vector")).alias("_w"))
    own = texts.select(key, vectors.unit(F.col("vector")).alias("_t"))
    scored = candidates.join(ready, "word").join(own, key).select(key, "word", vectors.dot(F.col("_t"), F.col("_w")).alias("s"))
    # A text is one document; its distinct words are a bounded group.
    order = Window.partitionBy(key).orderBy(F.desc("s"), "word")
    best = scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= count)
    cells = [F.coalesce(F.max(F.when(F.col("k") == i, F.col("word"))), F.lit("")).alias(f"keyword_{i}") for i in range(1, count + 1)]
    ranked = best.groupBy(key).agg(*cells)
    return texts.select(key).join(ranked, key, "left").na.fill("", [f"keyword_{i}" for i in range(1, count + 1)])
