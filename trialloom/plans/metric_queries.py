"""Classification, regression, vector-set and text-generation metrics."""

from pyspark.sql import functions as F

from trialloom.functions import keys, vectors
from trialloom.functions.fixed_values import STOP_WORDS
from trialloom.operators import inference, joins, metrics, reshape, splits, textmetrics
from trialloom.plans.registry import query
from trialloom.plans.retrieval_queries import rounded
from trialloom.plans.score_views import REPLICATES, sql_weights
from trialloom.plans.tables import SEED, VIEWS, sql_draw, sql_ring

CLASSES = 3
VIEWS["class_rows"] = """
SELECT doc_id AS id, quality + toxic AS y, CAST(CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 1200 THEN 1 ELSE 0 END AS INTEGER) AS yhat,
       CAST(CASE WHEN n_chars % 3 = 0 THEN 2 WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS yhat_b,
       n_chars, source AS subject_id, lang, 1 + doc_id % 4 AS weight FROM labels JOIN documents USING (doc_id)
"""
VIEWS["class_scores"] = """
SELECT id, class, CASE class WHEN 0 THEN -n_chars WHEN 1 THEN -abs(n_chars - 2000) ELSE n_chars // 50 END AS score, CAST(y = class AS INTEGER) AS positive,
       CAST(yhat = class AS INTEGER) AS guess FROM class_rows, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS class)
"""


def class_rows(t):
    docs = t.raw("documents").select("doc_id", "n_chars", "source", "lang")
    n = F.col("n_chars")
    return t.raw("labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("y"),
        F.when(n > 3000, 2).when(n > 1200, 1).otherwise(0).alias("yhat"),
        F.when(n % 3 == 0, 2).when(n % 3 == 1, 1).otherwise(0).alias("yhat_b"),
        "n_chars", F.col("source").alias("subject_id"), "lang", (1 + F.col("doc_id") % 4).alias("weight"))


def class_scores(t):
    n, c = F.col("n_chars"), F.col("class")
    score = F.when(c == 0, -n).when(c == 1, -F.abs(n - 2000)).otherwise(F.floor(n / 50))
    return reshape.each(class_rows(t), "class", [0, 1, 2]).select(
        "id", "class", score.alias("score"), (F.col("y") == c).cast("int").alias("positive"), (F.col("yhat") == c).cast("int").alias("guess"))


@query("A18_confusion_matrix", """
SELECT y, yhat, count(id) AS n FROM (SELECT * FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS y), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS yhat)) g
LEFT JOIN class_rows USING (y, yhat) GROUP BY 1, 2""")
def a18(t):
    return metrics.confusion(class_rows(t), CLASSES)


VIEWS["class_tpfn"] = """
SELECT class, count(*) FILTER (y = class AND yhat = class) AS tp, count(*) FILTER (y <> class AND yhat = class) AS fp, count(*) FILTER (y = class AND yhat <> class) AS fn
FROM class_rows, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS class) GROUP BY 1
"""
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END"


@query("A18_per_class", f"""
SELECT class, tp + fn AS support, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall, round({_F1}, 9) AS f1 FROM class_tpfn""")
def a18b(t):
    return rounded(metrics.per_class(class_rows(t), CLASSES), "precision", "recall", "f1", digits=9)


@query("A19_multiclass_metrics", f"""
SELECT round(avg({_F1}), 9) AS macro_f1, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 9) AS balanced_accuracy,
       round(sum(tp) / sum(tp + fn), 9) AS accuracy FROM class_tpfn""")
def a19(t):
    return rounded(metrics.multiclass_metrics(class_rows(t), CLASSES), "macro_f1", "balanced_accuracy", "accuracy", digits=9)


@query("A19_one_vs_rest_auroc", """
SELECT class, round((sum(r) FILTER (positive = 1) - sum(positive) * (sum(positive) + 1) / 2) / (sum(positive) * (count(*) - sum(positive))), 9) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS r FROM class_scores) GROUP BY 1""")
def a19b(t):
    return rounded(metrics.auroc(class_scores(t)), "auroc", digits=9)


VIEWS["class_ap"] = """
SELECT class, sum(p * (cp / cn)) / sum(p) AS ap FROM
 (SELECT class, score, p, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY class ORDER BY score DESC) AS cn
  FROM (SELECT class, score, sum(positive) AS p, count(*) AS n FROM class_scores GROUP BY 1, 2)) GROUP BY 1
"""


@query("A20_multilabel_metrics", f"""
SELECT round((SELECT avg({_F1}) FROM class_tpfn), 9) AS macro_f1, round((SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM class_tpfn), 9) AS micro_f1,
       round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM class_rows), 9) AS exact_match, round((SELECT avg(ap) FROM class_ap), 9) AS macro_average_precision""")
def a20(t):
    long = class_scores(t).withColumn("truth", F.col("positive"))
    return rounded(metrics.multilabel_metrics(long, CLASSES), "macro_f1", "micro_f1", "exact_match", "macro_average_precision", digits=9)


@query("A21_regression_metrics", """
, r AS (SELECT l_quantity AS y, round(l_extendedprice / 1500) AS yhat FROM lineitem),
k AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2 AS rp FROM r)
SELECT round(avg(abs(y - yhat)), 6) AS mae, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(ry, rp), 6) AS spearman_r FROM k""")
def a21(t):
    rows = t.raw("lineitem").select(F.col("l_quantity").alias("y"), F.round(F.col("l_extendedprice") / 1500).alias("yhat"))
    return rounded(metrics.regression_metrics(rows), "mae", "spearman_r", "r2", digits=6)


@query("A22_weighted_utility", """
, c AS (SELECT class, sum(weight) FILTER (y = class AND yhat = class) AS tp, sum(weight) FILTER (y <> class AND yhat = class) AS fp, sum(weight) FILTER (y = class AND yhat <> class) AS fn
 FROM class_rows, (SELECT unnest([0, 1, 2]) AS class) GROUP BY 1)
SELECT 'multiclass' AS target_type, round(avg(2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0))), 9) AS utility FROM c
UNION ALL SELECT 'regression', round(-sum(weight * abs(y - yhat)) / sum(weight), 9) FROM class_rows""")
def a22(t):
    rows = class_rows(t)
    parts = metrics.weighted_utility(rows, CLASSES, "weight").withColumn("target_type", F.lit("multiclass")).unionByName(
        metrics.weighted_error(rows, "weight").withColumn("target_type", F.lit("regression")))
    return rounded(parts, "utility", digits=9)


@query("A23_class_weights", """
SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / (10 * count(*)), 9) AS weight FROM embeddings GROUP BY 1""")
def a23(t):
    return rounded(metrics.class_weights(t.raw("embeddings").select("label"), "label", 10), "weight", digits=9)


@query("A24_label_distribution", """
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS label, count(*) AS n,
       round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1""")
def a24(t):
    return rounded(metrics.label_distribution(t.raw("events"), F.col("event_type"), ["view", "click", "purchase"]), "percent", digits=6)


@query("A25_standardised_targets", """
SELECT doc_id, round((length - m) / s, 6) AS z, round((length - m) / s * s + m, 6) AS restored
FROM split_trials, (SELECT avg(length) AS m, stddev_pop(length) AS s FROM split_trials WHERE split = 'train')""")
def a25(t):
    out = metrics.standardise(t.split_trials.select("doc_id", "length", "split"), "length", F.col("split") == "train")
    return rounded(out.select("doc_id", "z", "restored"), "z", "restored", digits=6)


@query("A26_vector_agreement", """
, p AS (SELECT CAST(embedding AS DOUBLE[]) AS b, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 3)) AS a FROM embeddings),
d AS (SELECT list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS d, list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) / greatest(abs(z[2]), 1e-8))) AS r,
      list_cosine_similarity(a, b) AS cos, len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > 2e-2 + 2e-3 * abs(z[2]))) = 0 AS c FROM p)
SELECT count(*) AS shared_count, round(max(d), 6) AS max_abs_diff, round(max(r), 6) AS max_rel_diff, round(min(cos), 6) AS min_cosine, round(avg(cos), 6) AS mean_cosine,
       bool_and(c) AS allclose, bool_and(c) AND min(cos) >= 0.9995 AS "match" FROM d""")
def a26(t):
    store = t.raw("embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("vector"))
    coarse = store.withColumn("vector", F.transform("vector", lambda x: F.round(x, 3)))
    return rounded(metrics.vector_agreement(joins.aligned(coarse, store, "vec_id")), "max_abs_diff", "max_rel_diff", "min_cosine", "mean_cosine", digits=6)


@query("A32_frechet_distance")
def a32(t):
    return metrics.frechet_distance(t.vec_trials.withColumn("side", (F.col("reading_task") == "NR").cast("int")), "vector", "side", 64)


_UTILITY_CELLS = ", ".join(
    f"count(*) FILTER (y = class AND {g} = class) AS tp_{s}, count(*) FILTER (y <> class AND {g} = class) AS fp_{s}, count(*) FILTER (y = class AND {g} <> class) AS fn_{s}"
    for s, g in (("a", "yhat"), ("b", "yhat_b")))
VIEWS["utility_cells"] = f"""
SELECT subject_id, lang AS text_key, class, {_UTILITY_CELLS} FROM class_rows, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS class) GROUP BY ALL
"""
VIEWS["w_utility"] = sql_weights("subject_id", "utility_cells")


def utility_cells(t):
    long = reshape.each(class_rows(t), "class", [0, 1, 2]).withColumnRenamed("lang", "text_key")
    y, c = F.col("y"), F.col("class")
    cells = []
    for side, guess in (("a", F.col("yhat")), ("b", F.col("yhat_b"))):
        cells += [F.count_if((y == c) & (guess == c)).alias(f"tp_{side}"), F.count_if((y != c) & (guess == c)).alias(f"fp_{side}"),
                  F.count_if((y == c) & (guess != c)).alias(f"fn_{side}")]
    return long.groupBy("subject_id", "text_key", "class").agg(*cells)


def _sum_f1(side):
    return f"sum(CASE WHEN 2 * tp_{side} + fp_{side} + fn_{side} = 0 THEN 0.0 ELSE 2 * tp_{side} / (2 * tp_{side} + fp_{side} + fn_{side}) END)"


_MEASURES = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]


@query("I06_utility_bootstrap", f"""
SELECT attempt AS replicate, round(({_sum_f1("a")} - {_sum_f1("b")}) / 3, 10) + 0.0 AS delta FROM
 (SELECT attempt, class, {", ".join(f"sum({m} * weight) AS {m}" for m in _MEASURES)} FROM utility_cells JOIN w_utility USING (subject_id) WHERE attempt < {REPLICATES} GROUP BY 1, 2) GROUP BY 1""")
def i06(t):
    return rounded(inference.macro_f1_bootstrap(utility_cells(t), ["subject_id"], CLASSES, REPLICATES, SEED), "delta")


PERMUTATIONS = 200


@query("I09_permutation_test")
def i09(t):
    """Balanced accuracy of the rule against label permutations."""
    rows = class_rows(t).select("id", "y", "yhat")
    observed = metrics.multiclass_metrics(rows, CLASSES).select("balanced_accuracy")
    shuffled = splits.permuted_labels(rows, "id", "y", PERMUTATIONS, SEED).join(rows.select("id", "yhat"), "id")
    cells = shuffled.groupBy("replicate", "y").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("recall"))
    null = cells.groupBy("replicate").agg(F.avg("recall").alias("balanced_accuracy"))
    return inference.permutation_p(null, observed, "balanced_accuracy")


WAYS = 4


@query("D09_n_way_retrieval", f"""
, s AS (SELECT trial_id, row_number() OVER (ORDER BY {sql_draw(SEED, "'place'", "trial_id")}, trial_id) - 1 AS p, count(*) OVER () AS n FROM vec_trials),
y AS (SELECT draw, try, {sql_draw(SEED, WAYS, "draw", "try")} % (SELECT max(n) FROM s) AS p
      FROM (SELECT unnest(range(300)) AS draw), (SELECT unnest(range({4 * WAYS + 16})) AS try)),
d AS (SELECT draw, p, row_number() OVER (PARTITION BY draw ORDER BY try) AS slot FROM (SELECT draw, p, min(try) AS try FROM y GROUP BY ALL) QUALIFY slot <= {WAYS}),
v AS (SELECT d.draw, d.slot, t.vector, x.text_vector FROM d JOIN s USING (p) JOIN vec_trials t USING (trial_id) JOIN vec_texts x ON x.text_key = t.text_key),
b AS (SELECT q.draw, q.slot AS q, c.slot AS c FROM v q JOIN v c ON q.draw = c.draw
      QUALIFY row_number() OVER (PARTITION BY q.draw, q.slot ORDER BY round(list_cosine_similarity(q.vector, c.text_vector), 12) DESC, c.slot) = 1)
SELECT CAST({WAYS} AS INTEGER) AS ways, count(DISTINCT draw) AS draws, avg(CASE WHEN q = c THEN 1.0 ELSE 0.0 END) AS accuracy FROM b""")
def d09(t):
    """Share of correct top choices among n random trials, queries and candidates being the same draw."""
    drawn = splits.n_way_draws(t.vec_trials, "trial_id", WAYS, 300, SEED)
    unit = t.vec_trials.select("trial_id", "text_key", vectors.unit(F.col("vector")).alias("v"))
    query_side = drawn.join(unit, "trial_id").select("draw", F.col("slot").alias("q"), F.col("v").alias("qv"))
    texts = t.vec_texts.select("text_key", vectors.unit(F.col("text_vector")).alias("tv"))
    cand_side = drawn.join(unit.drop("v"), "trial_id").join(texts, "text_key").select("draw", F.col("slot").alias("c"), "tv")
    scored = query_side.join(cand_side, "draw").withColumn("s", vectors.dot(F.col("qv"), F.col("tv")))
    best = scored.groupBy("draw", "q").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("best"))
    return best.agg(F.lit(WAYS).alias("ways"), F.count_distinct("draw").alias("draws"), F.avg((F.col("best") == F.col("q")).cast("double")).alias("accuracy"))


# --- text --------------------------------------------------------------------------------------------------------

_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _tok(x):
    return f"regexp_extract_all({x}, '{_TOK}')"


def references(t):
    """Two references per pair: the target, and the first half of the prediction."""
    from trialloom.functions.text import words

    w = words(F.col("prediction"))
    half = F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int"))), " ")
    return t.pairs.select("id", F.posexplode(F.array("target", half)).alias("ref", "reference"))


@query("T01_sentence_bleu")
def t01(t):
    return rounded(textmetrics.bleu(t.pairs, references(t)), "bleu1", "bleu2", "bleu3", "bleu4", digits=9)


_PLAIN = "list_filter({}, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]'))"


def _overlap_sql(expr):
    return f"""
, s AS (SELECT id, unnest({expr.format(_tok("lower(prediction)"))}) AS x, 1 AS side FROM pairs UNION ALL SELECT id, unnest({expr.format(_tok("lower(target)"))}), 0 FROM pairs),
c AS (SELECT id, x, sum(side) AS p, sum(1 - side) AS t FROM s GROUP BY 1, 2),
o AS (SELECT id, sum(least(p, t)) AS hits, sum(p) AS predicted, sum(t) AS wanted FROM c GROUP BY 1)
"""


@query("T02_rouge1", _overlap_sql(_PLAIN) + """
SELECT id, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS fmeasure
FROM (SELECT id, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p, CASE WHEN wanted > 0 THEN hits / wanted ELSE 0.0 END AS r FROM o)""")
def t02(t):
    return rounded(textmetrics.rouge1(t.pairs), "precision", "recall", "fmeasure", digits=9)


@query("T03_word_error_rate")
def t03(t):
    return textmetrics.word_error_rate(t.pairs)


@query("T04_distinct_n", f"""
, k AS (SELECT {_tok("lower(prediction)")} AS t FROM pairs),
g AS (SELECT 1 AS n, unnest(t) AS gram FROM k UNION ALL SELECT 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM k)
SELECT CAST(n AS INTEGER) AS n, count(DISTINCT gram) AS "distinct", count(*) AS total, round(count(DISTINCT gram) / count(*), 9) AS share FROM g GROUP BY 1""")
def t04(t):
    return rounded(textmetrics.distinct_share(t.pairs), "share", digits=9)


_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_CONTENT = "list_filter({}, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$') AND w NOT IN " + _STOPS + ")"


@query("T05_content_recall", _overlap_sql(_CONTENT) + "SELECT id, round(hits / wanted, 9) AS recall FROM o WHERE wanted > 0")
def t05(t):
    return rounded(textmetrics.content_recall(t.pairs), "recall", digits=9)


@query("T06_head_entropy", f"""
SELECT round(-sum(c / n * log2(c / n)), 9) AS head_entropy FROM (SELECT c, sum(c) OVER () AS n FROM
 (SELECT count(*) AS c FROM (SELECT {_tok("lower(prediction)")} AS t FROM pairs) WHERE len(t) >= 2 GROUP BY t[1], t[2]))""")
def t06(t):
    return rounded(textmetrics.head_entropy(t.pairs), "head_entropy", digits=9)


@query("T07_mean_paired_cosine", """
SELECT round(avg(list_cosine_similarity(v.vector, x.text_vector)), 9) AS cosine, count(*) AS pairs FROM vec_trials v JOIN vec_texts x USING (text_key)""")
def t07(t):
    pairs = t.vec_trials.select("text_key", vectors.unit(F.col("vector")).alias("a")).join(
        t.vec_texts.select("text_key", vectors.unit(F.col("text_vector")).alias("b")), "text_key")
    return rounded(pairs.agg(F.avg(vectors.dot(F.col("a"), F.col("b"))).alias("cosine"), F.count("*").alias("pairs")), "cosine", digits=9)


@query("T08_greedy_token_f1")
def t08(t):
    toks = t.vec_trials.select("trial_id", "text_key", vectors.fold_rows(F.col("vector"), 8, 8).alias("prediction_tokens"))
    texts = t.vec_texts.select("text_key", vectors.fold_rows(F.col("text_vector"), 8, 8).alias("target_tokens"))
    ones = F.array_repeat(F.lit(1), 8)
    return textmetrics.greedy_token_f1(toks.join(texts, "text_key").withColumns({"prediction_mask": ones, "target_mask": ones}), "trial_id")


@query("T09_cider")
def t09(t):
    return rounded(textmetrics.cider(t.pairs), "cider", digits=6)


@query("T10_self_bleu")
def t10(t):
    return rounded(textmetrics.self_bleu(t.pairs), "bleu1", "bleu2", "bleu3", "bleu4", digits=9)


@query("T11_length_error", f"""
SELECT round(avg(abs(len({_tok("prediction")}) - len({_tok("target")}))), 9) AS length_mae, count(*) AS pairs FROM pairs""")
def t11(t):
    return rounded(textmetrics.length_error(t.pairs), "length_mae", digits=9)


@query("T12_variant_references", """
, v AS (SELECT target AS "input text", min(CASE WHEN conv_id % 3 <> 0 THEN 'a ' || target END) AS v0, min(CASE WHEN conv_id % 2 = 0 THEN 'b ' || target END) AS v1 FROM pairs GROUP BY 1)
SELECT id, CAST(i - 1 AS INTEGER) AS ref, refs[i] AS reference FROM (SELECT id, refs, unnest(range(1, len(refs) + 1)) AS i FROM
 (SELECT p.id, CASE WHEN v0 IS NULL AND v1 IS NULL THEN [target] ELSE list_filter([v0, v1], lambda x: x IS NOT NULL) END AS refs FROM pairs p JOIN v ON v."input text" = p.target))""")
def t12(t):
    c = F.col("conv_id")
    variants = t.pairs.groupBy(F.col("target").alias("input text")).agg(
        F.min(F.when(c % 3 != 0, F.concat(F.lit("a "), "target"))).alias("v0"), F.min(F.when(c % 2 == 0, F.concat(F.lit("b "), "target"))).alias("v1"))
    return textmetrics.variant_references(t.pairs, variants, "input text", ["v0", "v1"])
