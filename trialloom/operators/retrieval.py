"""Scoring of candidate pools, ranks of the positive, and the metrics built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.functions import vectors
from trialloom.functions.fixed_values import TOP1_SLACK
from trialloom.operators import blocks


def cosine_scores(pool: DataFrame, signals: DataFrame, texts: DataFrame, out: str = "score", context: list[str] | None = None,
                  target: list[str] | None = None, near: list[Column] | None = None) -> DataFrame:
    """Cosine of each pool row's signal and candidate vectors, by blocks of targets (``blocks.pair_scores``).

    pool: signal_id, candidate_id and anything else. signals: signal_id, vector; texts: candidate_id, vector, one row per id.
    ``context`` and ``near`` tell which targets share candidates; without them targets are dealt by hash.
    """
    return blocks.pair_scores(
        pool, signals.select("signal_id", F.col("vector").alias("payload")),
        texts.select("candidate_id", F.col("vector").alias("payload")), context or [], target or ["signal_id"], near, out, blocks.cosine_kernel)


def maxsim_scores(pool: DataFrame, signals: DataFrame, texts: DataFrame, out: str = "score", context: list[str] | None = None,
                  target: list[str] | None = None, near: list[Column] | None = None) -> DataFrame:
    """Late interaction: mean over valid signal tokens of the best cosine with a valid candidate token, by blocks."""
    def ready(df, key):
        return df.select(key, vectors.keep_valid(F.col("tokens"), F.col("mask")).alias("payload"))

    return blocks.pair_scores(pool, ready(signals, "signal_id"), ready(texts, "candidate_id"), context or [], target or ["signal_id"],
                              near, out, blocks.maxsim_kernel)


def rank_positive(scores: DataFrame, query: list[str]) -> DataFrame:
    """Per query: rank of the positive under both tie rules, and its margin over the best negative.

    ``positive_rank`` breaks ties by the frozen candidate order, ``worst_rank`` counts every tie against the positive.
    One shuffle by query; pools have a fixed size, so a query never is a large group.
    """
    pool = Window.partitionBy(*query)
    positive = F.max(F.when(F.col("is_positive") == 1, F.struct(F.col("score").alias("s"), F.col("candidate_rank").alias("r")))).over(pool)
    marked = scores.withColumn("_p", positive)
    ahead = (F.col("score") > F.col("_p.s")) | ((F.col("score") == F.col("_p.s")) & (F.col("candidate_rank") < F.col("_p.r")))
    return marked.groupBy(*query).agg(
        (F.count_if(ahead) + 1).cast("int").alias("positive_rank"),
        F.count_if(F.col("score") >= F.col("_p.s")).cast("int").alias("worst_rank"),
        (F.max(F.when(F.col("is_positive") == 1, F.col("score"))) - F.max(F.when(F.col("is_positive") == 0, F.col("score")))).alias("margin"),
        F.count("*").cast("int").alias("candidate_pool_size"),
        F.max_by("candidate_id", F.struct("score", -F.col("candidate_rank"))).alias("top_candidate_id"),
    )


def pool_rows(scores: DataFrame, query: list[str], value: str) -> DataFrame:
    """One row per query with its ``pool``, an array of (candidate_id, candidate_rank, is_positive, is_donor_text, ``value``).
    Pools have a fixed size. Rows of a query that lie together combine before they move."""
    return scores.groupBy(*query).agg(F.collect_list(F.struct("candidate_id", "candidate_rank", "is_positive", "is_donor_text", value)).alias("pool"))


def rank_pools(pools: DataFrame, query: list[str]) -> DataFrame:
    """What ``rank_positive`` gives, from whole pools (``pool_rows``, with ``score``): each row by itself, nothing moves."""
    def flagged(flag: int) -> Column:
        return F.filter("pool", lambda c: c["is_positive"] == flag)

    held = pools.select(*query, "pool", F.array_max(F.transform(flagged(1), lambda c: F.struct(
        c["score"].alias("s"), c["candidate_rank"].alias("r")))).alias("_p"))
    s, r = F.col("_p.s"), F.col("_p.r")
    best = F.array_max(F.transform("pool", lambda c: F.struct(
        c["score"].alias("s"), (-c["candidate_rank"]).alias("r"), c["candidate_id"].alias("id"))))
    return held.select(
        *query, (F.size(F.filter("pool", lambda c: (c["score"] > s) | ((c["score"] == s) & (c["candidate_rank"] < r)))) + 1).alias("positive_rank"),
        F.size(F.filter("pool", lambda c: c["score"] >= s)).alias("worst_rank"),
        (s - F.array_max(F.transform(flagged(0), lambda c: c["score"]))).alias("margin"),
        F.size("pool").alias("candidate_pool_size"), best["id"].alias("top_candidate_id"))


def with_hits(ranked: DataFrame) -> DataFrame:
    rank = F.col("positive_rank")
    return ranked.withColumns({
        "reciprocal_rank": 1.0 / rank, "top1": (rank <= 1).cast("int"), "top5": (rank <= 5).cast("int")})


def top1_of(reciprocal: Column) -> Column:
    """1 when a (possibly averaged) reciprocal rank is 1 up to rounding, so every seed ranked first."""
    return (reciprocal >= 1.0 - TOP1_SLACK).cast("double")


def chance_mrr(size: Column) -> Column:
    """H_n / n."""
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda acc, k: acc + 1.0 / k) / size


def retrieval_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg("top1").alias("top1"), F.avg("top5").alias("top5"),
        F.avg("reciprocal_rank").alias("mrr"), F.avg("positive_rank").alias("mean_positive_rank"),
        F.avg("margin").alias("mean_margin"))


def task_macro(df: DataFrame, by: list[str], value: str, task: str = "reading_task", out: str = "macro") -> DataFrame:
    """Mean of the per-task means."""
    per_task = df.groupBy(*by, task).agg(F.avg(value).alias("_m"))
    return per_task.groupBy(*by).agg(F.avg("_m").alias(out), F.count("*").alias("tasks"))


def seed_average(predictions: DataFrame, trial: list[str], seeds: int, value: str = "reciprocal_rank") -> DataFrame:
    """Mean over seeds per trial; ``complete`` tells whether every seed is there exactly once."""
    return predictions.groupBy("arm_id", "signal_condition", *trial).agg(
        F.avg(value).alias(value),
        ((F.count("*") == seeds) & (F.size(F.collect_set("training_seed")) == seeds)).alias("complete"))


def wide_by_arm(averaged: DataFrame, trial: list[str], arms: list[str], conditions: list[str], value: str = "reciprocal_rank") -> DataFrame:
    """One row per trial with a column ``<arm>::<condition>`` each: arms and conditions are fixed literals."""
    cells = [F.max(F.when((F.col("arm_id") == a) & (F.col("signal_condition") == c), F.col(value))).alias(f"{a}::{c}")
             for a in arms for c in conditions]
    return averaged.groupBy(*trial).agg(*cells)


def effect_rows(wide: DataFrame, trial: list[str], effects: dict[str, Column]) -> DataFrame:
    """Long form (trial, contrast, effect); effects with a missing arm are left out."""
    cells = [F.struct(F.lit(name).alias("contrast"), col.alias("effect")) for name, col in effects.items()]
    return wide.select(*trial, F.inline(F.array(*cells))).where("effect is not null")


def seedwise_deltas(predictions: DataFrame, model: str, baselines: list[str]) -> DataFrame:
    """Macro MRR of the model minus each baseline per seed, on the correct signal."""
    macro = task_macro(predictions.where("signal_condition = 'correct'"), ["arm_id", "training_seed"], "reciprocal_rank")
    own = macro.where(F.col("arm_id") == model).select("training_seed", F.col("macro").alias("_own"))
    other = macro.where(F.col("arm_id").isin(baselines)).select(F.col("arm_id").alias("reference_id"), "training_seed", "macro")
    return other.join(own, "training_seed").select(
        "reference_id", "training_seed", (F.col("_own") - F.col("macro")).alias("macro_mrr_delta"),
        (F.col("_own") > F.col("macro")).alias("direction_positive"))


def donor_attraction(ranked: DataFrame) -> DataFrame:
    """Share of wrong-signal queries whose best candidate is the text the signal belongs to."""
    wrong = ranked.where("signal_condition = 'matched_wrong'")
    return wrong.groupBy("arm_id").agg(
        F.avg((F.col("top_candidate_id") == F.col("donor_text_key")).cast("double")).alias("donor_share"))


def mean_scores(scores: DataFrame, pair: list[str]) -> DataFrame:
    """Ensemble: mean score per (query, candidate) over seeds or adapters."""
    return scores.groupBy(*pair).agg(F.avg("score").alias("score"), F.count("*").alias("members"))


def contrastive_loss(pairs: DataFrame, temperature: float) -> DataFrame:
    """Symmetric cross entropy of scored pairs: (anchor, candidate, score, forward, backward) with mask flags.

    Per direction the log-sum-exp over the admitted pairs of an anchor, shifted by its maximum; a batch is one group
    of anchors of fixed size. Returns one row per batch.
    """
    def one_way(anchor: str, mask: str) -> DataFrame:
        logit = F.col("score") / temperature
        admitted = pairs.where(F.col(mask)).withColumn("_l", logit)
        top = Window.partitionBy("batch", anchor)
        shifted = admitted.withColumn("_m", F.max("_l").over(top))
        per = shifted.groupBy("batch", anchor).agg(
            (F.max("_m") + F.log(F.sum(F.exp(F.col("_l") - F.col("_m"))))).alias("_lse"),
            F.max(F.when(F.col("anchor") == F.col("candidate"), F.col("_l"))).alias("_own"))
        return per.groupBy("batch").agg(F.avg(F.col("_lse") - F.col("_own")).alias("loss"))

    forward = one_way("anchor", "forward").withColumnRenamed("loss", "forward_loss")
    backward = one_way("candidate", "backward").withColumnRenamed("loss", "backward_loss")
    return forward.join(backward, "batch").withColumn("loss", (F.col("forward_loss") + F.col("backward_loss")) / 2)
