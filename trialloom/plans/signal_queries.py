"""Signals, tokens, adapters, encoders."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.functions import keys, vectors
from trialloom.operators import retrieval, signals, textmetrics, tokens
from trialloom.plans.registry import query
from trialloom.plans.retrieval_queries import rounded
from trialloom.plans.score_views import base_scores
from trialloom.plans.tables import SEED, VIEWS

WIDTH = 8


def token_table(t):
    """The 64-wide vectors as eight tokens of eight; the mask hides the last token of every third."""
    mask = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((i < 8) | (F.col("vec_id") % 3 != 0)).cast("int"))
    return t.vec_trials.select("vec_id", "trial_id", "text_key", vectors.fold_rows(F.col("vector"), 8, 8).alias("tokens"), mask.alias("mask"))


VIEWS["token_rows"] = """
SELECT vec_id, trial_id, text_key, list_transform(range(1, CASE WHEN vec_id % 3 = 0 THEN 8 ELSE 9 END), lambda i: vector[8 * i - 7 : 8 * i]) AS tokens FROM vec_trials
"""


@query("X03_maxsim", """
, u AS (SELECT b.trial_id, b.candidate_id, q.tokens AS qt, c.tokens AS ct FROM base_scores b JOIN token_rows q ON q.trial_id = b.trial_id
  JOIN (SELECT text_key, arg_min(tokens, vec_id) AS tokens FROM token_rows GROUP BY 1) c ON c.text_key = b.candidate_id WHERE signal_condition = 'correct')
SELECT trial_id, candidate_id, round(list_avg(list_transform(qt, lambda x: list_max(list_transform(ct, lambda y: list_cosine_similarity(x, y))))), 6) AS score FROM u""")
def x03(t):
    pool = base_scores(t).where("signal_condition = 'correct'").select("trial_id", "signal_id", "candidate_id")
    toks = token_table(t)
    query_side = toks.select(F.col("trial_id").alias("signal_id"), "tokens", "mask")
    first = toks.groupBy("text_key").agg(F.min_by(F.struct("tokens", "mask"), "vec_id").alias("r"))
    cand_side = first.select(F.col("text_key").alias("candidate_id"), "r.tokens", "r.mask")
    return rounded(retrieval.maxsim_scores(pool, query_side, cand_side).select("trial_id", "candidate_id", "score"), "score", digits=6)


@query("X04_mean_collapse", """
SELECT trial_id, round(list_avg(list_transform(tokens, lambda x: x[1])), 6) AS first, round(list_avg(list_transform(tokens, lambda x: x[8])), 6) AS last FROM token_rows""")
def x04(t):
    mean = vectors.mean_token(vectors.keep_valid(F.col("tokens"), F.col("mask")))
    return rounded(token_table(t).select("trial_id", mean.alias("m")).select(
        "trial_id", F.element_at("m", 1).alias("first"), F.element_at("m", 8).alias("last")), "first", "last", digits=6)


def weights(name: str, rank: int = 4, width: int = 64):
    """Small fixed adapter weights for the examples; a user passes trained ones."""
    rng = np.random.default_rng(sum(name.encode()))
    return rng.normal(0, 0.2, (rank, width)), rng.normal(0, 0.2, (width, rank))


@query("X05_residual_projection")
def x05(t):
    out = tokens.residual_projection(t.vec_trials, "trial_id", *weights("shared"))
    return out.select("trial_id", F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


@query("X06_routed_projection")
def x06(t):
    tasks = ["NR", "TSR"]
    parts = []
    for condition in ("correct", "masked", "shuffled"):
        rows = t.vec_trials.withColumn("route", tokens.route(F.col("reading_task"), tasks, condition))
        out = tokens.routed_projection(rows, "trial_id", "route", [weights(x) for x in tasks], weights("shared"))
        parts.append(out.select("trial_id", F.lit(condition).alias("task_condition"), F.round(vectors.norm(F.col("vector")), 6).alias("norm")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("X12_effective_rank")
def x12(t):
    return tokens.trial_shapes(token_table(t), "trial_id").select("trial_id", F.round("effective_rank", 6).alias("effective_rank"))


@query("A27_collapse_report")
def a27(t):
    return tokens.collapse_report(token_table(t), "trial_id")


@query("A28_position_liveness", """
SELECT CAST(p - 1 AS INTEGER) AS position, round(avg(v), 9) AS variance FROM
 (SELECT p, d, var_samp(vector[8 * (p - 1) + d]) AS v FROM vec_trials, (SELECT unnest(range(1, 9)) AS p), (SELECT unnest(range(1, 9)) AS d) GROUP BY 1, 2) GROUP BY 1""")
def a28(t):
    return rounded(tokens.position_variance(token_table(t)), "variance", digits=9)


@query("I16_token_verdict", """
SELECT trial_id, CASE WHEN mn = 0 THEN 'INVALID' WHEN r > 0.97 THEN 'COLLAPSED' WHEN r > 0.9 THEN 'WEAK' ELSE 'RICH' END AS verdict FROM
 (SELECT trial_id, list_min(list_transform(tokens, lambda x: sqrt(list_dot_product(x, x)))) AS mn,
  (list_sum(list_transform(tokens, lambda x: list_sum(list_transform(tokens, lambda y: list_cosine_similarity(x, y))))) - 8) / 56 AS r
  FROM (SELECT trial_id, list_transform(range(1, 9), lambda i: vector[8 * i - 7 : 8 * i]) AS tokens FROM vec_trials))""")
def i16(t):
    from trialloom.operators.decisions import token_verdict

    s = tokens.trial_shapes(token_table(t), "trial_id")
    return s.select("trial_id", token_verdict(F.col("redundancy"), F.col("effective_rank"), F.col("tokens"), F.col("finite") == 1, F.col("norm_min")).alias("verdict"))


# --- signals -----------------------------------------------------------------------------------------------------

VIEWS["order_signals"] = """
SELECT o_orderkey AS record_id, list([l_quantity, l_extendedprice, l_discount, l_tax] ORDER BY l_linenumber, l_partkey, l_extendedprice) AS signal
FROM (SELECT * EXCLUDE (l_extendedprice), CASE WHEN l_partkey % 400 = 7 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS l_extendedprice FROM lineitem)
JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
"""


def order_signals(t):
    """One record per order: lines are time steps, four measures are channels; a few prices are not finite."""
    price = F.when(F.col("l_partkey") % 400 == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    line = t.raw("lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.struct("l_linenumber", "l_partkey", price.alias("price"), "l_quantity", "l_discount", "l_tax").alias("s"))
    known = t.raw("orders").select(F.col("o_orderkey").alias("record_id"))
    rows = line.join(known, "record_id").groupBy("record_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("record_id", F.transform("s", lambda x: F.array(x["l_quantity"], x["price"], x["l_discount"], x["l_tax"])).alias("signal"))


@query("X07_finite_signals", """
SELECT record_id, len(signal) AS steps FROM order_signals WHERE len(list_filter(signal, lambda r: isnan(r[2]))) = 0""")
def x07(t):
    return order_signals(t).where(signals.finite_signal(F.col("signal"))).select("record_id", F.size("signal").cast("bigint").alias("steps"))


@query("X08_duration_screen", """
SELECT record_id, CASE WHEN len(list_filter(signal, lambda r: isnan(r[2]))) > 0 THEN 'not_finite' WHEN len(signal) < 2 THEN 'short' WHEN len(signal) > 6 THEN 'long' END AS reason,
       3 AS channels FROM order_signals""")
def x08(t):
    out = signals.screen(order_signals(t), "signal", 2, 6)
    return out.select("record_id", "reason", F.size(F.element_at("signal", 1)).alias("channels"))


@query("X08_drop_counters", """
SELECT coalesce(CASE WHEN len(list_filter(signal, lambda r: isnan(r[2]))) > 0 THEN 'not_finite' WHEN len(signal) < 2 THEN 'short' WHEN len(signal) > 6 THEN 'long' END, 'kept') AS reason,
       count(*) AS records FROM order_signals GROUP BY 1""")
def x08b(t):
    return signals.screen(order_signals(t), "signal", 2, 6).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("records"))


def user_signals(t):
    """One record per user and hundred events: values in time order, two channels (value, running index)."""
    from trialloom.plans.contract_queries import history

    rows = history(t).withColumn("part", F.floor(F.col("epoch") / 50))
    per = rows.groupBy("user_id", "part").agg(F.array_sort(F.collect_list(F.struct("epoch", "value"))).alias("s"))
    return per.select(F.format_string("u%06d_%04d", "user_id", "part").alias("record_id"),
                      F.transform("s", lambda x: F.array(x["value"], x["epoch"].cast("double"))).alias("signal"))


@query("X09_fourier_resample")
def x09(t):
    """Signals of fewer than eight steps are returned with a reason instead of values."""
    rows = user_signals(t)
    out = signals.resample(rows.where(F.size("signal") >= 8), ["record_id"], source=2, target=1).select(
        "record_id", F.size("signal").alias("steps"), F.round(F.element_at(F.element_at("signal", 1), 1), 6).alias("first"), F.lit("kept").alias("reason"))
    return out.unionByName(rows.where(F.size("signal") < 8).select(
        "record_id", F.size("signal").alias("steps"), F.lit(None).cast("double").alias("first"), F.lit("short").alias("reason")))


@query("X10_pad_and_mask", """
SELECT record_id, len(signal) AS steps, CASE WHEN len(signal) <= 12 THEN 12 END AS padded, CASE WHEN len(signal) <= 12 THEN 6 END AS width,
       CASE WHEN len(signal) <= 12 THEN CAST(len(signal) AS INTEGER) END AS valid, CASE WHEN len(signal) <= 12 THEN 'kept' ELSE 'long' END AS reason FROM order_signals""")
def x10(t):
    rows, fits = order_signals(t), F.size("signal") <= 12
    padded, mask = signals.pad(F.col("signal"), 12, 6), signals.valid_mask(F.size("signal"), 12)
    return rows.select("record_id", F.size("signal").cast("bigint").alias("steps"), F.when(fits, F.size(padded)).alias("padded"),
                       F.when(fits, F.size(F.element_at(padded, 12))).alias("width"), F.when(fits, F.aggregate(mask, F.lit(0), lambda a, m: a + m)).alias("valid"),
                       F.when(fits, "kept").otherwise("long").alias("reason"))


@query("X11_masked_normalise", """
, q AS (SELECT record_id, list_transform(signal, lambda r: CASE WHEN r[3] = 0.05 THEN 0.0 ELSE r[1] END) AS x FROM order_signals),
s AS (SELECT record_id, x, list_filter(x, lambda v: v <> 0) AS live FROM q),
m AS (SELECT record_id, x, list_avg(live) AS mu, sqrt(list_avg(list_transform(live, lambda v: (v - list_avg(live)) * (v - list_avg(live))))) AS sd FROM s)
SELECT record_id, round(list_sum(list_transform(x, lambda v: CASE WHEN v = 0 THEN 0.0 ELSE abs(least(greatest((v - mu) / (sd + 1e-6), -10), 10)) END)), 5) AS spread FROM m""")
def x11(t):
    x = F.transform("signal", lambda r: F.when(F.element_at(r, 3) == 0.05, F.lit(0.0)).otherwise(F.element_at(r, 1)))
    rows = order_signals(t).select("record_id", x.alias("x"))
    z = signals.normalise_masked(F.col("x"))
    return rows.select("record_id", F.round(F.aggregate(z, F.lit(0.0), lambda a, v: a + F.abs(v)), 5).alias("spread"))


@query("W09_difference_array", """
SELECT record_id, round(list_sum(list_transform(range(1, len(signal) + 1), lambda i: abs(signal[i][1] - 0.95 * coalesce(CASE WHEN i > 1 THEN signal[i - 1][1] END, 0)))), 6) AS total FROM order_signals""")
def w09b(t):
    x = F.transform("signal", lambda r: F.element_at(r, 1))
    rows = order_signals(t).select("record_id", x.alias("x"))
    return rows.select("record_id", F.round(F.aggregate(
        signals.difference_array(F.col("x"), 0.95), F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"))


@query("A10_channel_stats", """
SELECT l_returnflag, channel, count(*) AS samples, round(avg(value), 6) AS mean, round(sqrt(greatest(var_pop(value), 1e-12)), 6) AS std
FROM (SELECT l_returnflag, l_linestatus, unnest(['quantity', 'price', 'discount', 'tax']) AS channel, unnest([l_quantity, l_extendedprice / 1000, l_discount, l_tax]) AS value FROM lineitem)
WHERE l_linestatus = 'F' GROUP BY 1, 2""")
def a10(t):
    long = t.raw("lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").alias("valid"), F.inline(F.array(
        *[F.struct(F.lit(n).alias("channel"), v.alias("value")) for n, v in (
            ("quantity", F.col("l_quantity")), ("price", F.col("l_extendedprice") / 1000), ("discount", F.col("l_discount")), ("tax", F.col("l_tax")))])))
    return rounded(signals.channel_stats(long, ["l_returnflag"]), "mean", "std", digits=6)


@query("A10_array_channel_stats", """
SELECT CAST(c - 1 AS INTEGER) AS channel, count(*) AS samples, round(avg(v), 5) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)), 5) AS std FROM
 (SELECT c, r[c] AS v FROM (SELECT unnest(signal[1:3]) AS r FROM order_signals), (SELECT unnest([1, 3, 4]) AS c)) GROUP BY 1""")
def a10b(t):
    mask = F.transform(F.sequence(F.lit(1), F.size("signal")), lambda i: (i <= 3).cast("int"))
    out = signals.array_channel_stats(order_signals(t).withColumn("mask", mask))
    return rounded(out.where("channel <> 1"), "mean", "std", digits=5)


def control_rows(t):
    s = F.struct(F.lit(0.5).alias("mean"), F.lit(2.0).alias("std"))
    return order_signals(t).select(
        "record_id", keys.draw_hash(SEED, F.col("record_id"), "gaussian").alias("seed"),
        F.transform("signal", lambda r: F.lit(1)).alias("mask"), F.array(s, s, s, s).alias("stats"))


@query("D16_control_signals")
def d16(t):
    """Zero and seeded Gaussian controls of every record, reduced to their energy."""
    def energy(df, kind):
        total = F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, v: a + v * v)
        return df.select("record_id", F.lit(kind).alias("condition"), F.round(total, 6).alias("energy"))

    rows = control_rows(t)
    return energy(signals.control_signal(rows, "record_id", "zero"), "zero").unionByName(
        energy(signals.control_signal(rows, "record_id", "gaussian"), "gaussian"))


@query("D17_channel_replacement")
def d17(t):
    rows = token_table(t).select("trial_id", keys.draw_hash(SEED, F.col("trial_id"), "drop").alias("seed"), F.col("tokens").alias("signal"))
    out = signals.replace_channels(rows, "trial_id", 0.5)
    return out.select("trial_id", "replaced", F.size("signal").alias("channels"))


# --- pluggable encoders ------------------------------------------------------------------------------------------


def mean_encoder(batch: pd.DataFrame) -> pd.DataFrame:
    """Example encoder: mean of the valid samples of a signal."""
    means = [np.mean(np.nan_to_num(np.stack([np.asarray(r, dtype=float) for r in s])), axis=0).tolist() for s in batch["signal"]]
    return pd.DataFrame({"record_id": batch["record_id"], "vector": means})


@query("X13_pluggable_encoder", """
SELECT record_id, round(list_avg(list_transform(signal, lambda r: r[1])), 6) AS first, 4 AS width FROM order_signals""")
def x13(t):
    out = signals.map_encode(order_signals(t), mean_encoder, "record_id long, vector array<double>")
    return out.select("record_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.size("vector").alias("width"))


def rule_labels(batch: pd.DataFrame) -> pd.DataFrame:
    """Example text labels: a question or a statement, a neutral default for the sentiment."""
    return pd.DataFrame({"text": batch["text"], "type_label": ["question" if "?" in x else "statement" for x in batch["text"]],
                         "sentiment": ["neutral"] * len(batch), "surprisal": [float(len(set(x))) for x in batch["text"]]})


@query("X14_text_labels", """
SELECT conv_id, turn, CASE WHEN text LIKE '%?%' THEN 'question' ELSE 'statement' END AS type_label, 'neutral' AS sentiment FROM conversations""")
def x14(t):
    turns = t.raw("conversations").select("conv_id", "turn", "text")
    out = signals.encode_distinct(turns, "text", rule_labels, "text string, type_label string, sentiment string, surprisal double")
    return out.select("conv_id", "turn", "type_label", "sentiment")


@query("X15_prediction_packing", """
SELECT record_id, round(list_avg(list_transform(signal, lambda r: r[1])), 6) AS pred_value, o_orderstatus, o_orderpriority FROM order_signals JOIN orders ON o_orderkey = record_id""")
def x15(t):
    out = signals.map_encode(order_signals(t), mean_encoder, "record_id long, vector array<double>")
    packed = out.select("record_id", F.round(F.element_at("vector", 1), 6).alias("pred_value"))
    meta = t.raw("orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus", "o_orderpriority")
    return packed.join(meta, "record_id")


@query("W13_top_keywords")
def w13(t):
    """Texts of ``pairs`` with vectors by position, terms with hashed vectors: the shape a user's own vectors have."""
    def hashed(key):
        return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: keys.uniform(SEED, key, i) - 0.5)

    texts = t.pairs.select("id", F.col("target").alias("text"), hashed(F.col("id")).alias("vector"))
    terms = texts.select(F.explode(textmetrics.tokens(F.lower("text"))).alias("word")).distinct()
    return textmetrics.top_keywords(texts, terms.withColumn("vector", hashed(F.col("word"))), "id")
