"""Length-matched candidate pools and donors without a quadratic join.

The nearest candidates of a target are found in three steps, each linear in the data:
the length histogram of a context tells which lengths can hold one of the ``need`` nearest candidates and how many
to take of each; the candidates of one (context, length) sit on a hash ring, and a target takes the next ones behind
its own hash; only these few survivors are ranked. Ties in length are thus broken by the clockwise ring distance of
two seeded hashes, so a length shared by a third of all candidates costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.functions.keys import ring_distance, ring_hash, stable_hash
from trialloom.operators.ranking import position_by_ring, prefix_sum, ring_bucket
from trialloom.operators.reshape import with_totals
from trialloom.session import cut


def length_quotas(targets: DataFrame, candidates: DataFrame, context: list[str], need: int) -> DataFrame:
    """(context, target_length, candidate_length, quota, ring_size): how many to take of which length."""
    have = candidates.groupBy(*context, F.col("candidate_length").alias("length")).agg(F.count("*").alias("n"))
    want = targets.select(*context, F.col("target_length").alias("length")).distinct().withColumn("n", F.lit(0))
    profile = have.withColumn("wanted", F.lit(0)).unionByName(want.withColumn("wanted", F.lit(1)))
    profile = profile.groupBy(*context, "length").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted"))
    by_length = Window.partitionBy(*context).orderBy("length")
    profile = profile.withColumn("slot", F.sum((F.col("n") > 0).cast("int")).over(by_length))
    sides = profile.where("n > 0").select(
        *context, "slot", F.col("length").alias("candidate_length"), F.col("n").alias("ring_size"))
    near = (
        profile.where("wanted = 1")
        .select(*context, F.col("length").alias("target_length"),
                F.explode(F.sequence(F.col("slot") - need, F.col("slot") + need + 1)).alias("slot"))
        .join(sides, [*context, "slot"])
        .withColumn("gap", F.abs(F.col("candidate_length") - F.col("target_length")))
    )
    closer = (Window.partitionBy(*context, "target_length").orderBy("gap")
              .rangeBetween(Window.unboundedPreceding, -1))
    return (
        near.withColumn("closer", F.coalesce(F.sum("ring_size").over(closer), F.lit(0)))
        .where(F.col("closer") < need)
        .select(*context, "target_length", "candidate_length", "ring_size",
                F.least(F.col("ring_size"), F.lit(need) - F.col("closer")).cast("int").alias("quota"))
    )


def ring_starts(points: DataFrame, members: DataFrame, keys: list[str], point_ring: str, member_ring: str) -> DataFrame:
    """Adds ``start``: how many members of the key lie before the point on the ring. Members bring their hash only."""
    carried = [c for c in points.columns if c not in keys]
    left = points.select(*keys, F.col(point_ring).alias("_ring"), F.lit(0).alias("_member"),
                         F.struct(*carried).alias("_point"))
    right = members.select(*keys, F.col(member_ring).alias("_ring"), F.lit(1).alias("_member"))
    merged = left.unionByName(right, allowMissingColumns=True)
    counted = prefix_sum(merged, keys, ring_bucket(F.col("_ring")), ["_ring", "_member"], F.col("_member"), "start")
    return counted.where("_member = 0").select(*keys, "start", "_point.*")


def nearest_candidates(targets: DataFrame, candidates: DataFrame, context: list[str], need: int) -> DataFrame:
    """A superset of the ``need`` nearest candidates per target.

    targets: target_id, context, target_length, target_ring. candidates: candidate_id, context, candidate_length,
    candidate_ring, anything else (kept). Adds ``gap`` and ``ring_gap``; order by both to rank.
    """
    keys = [*context, "candidate_length"]
    lines = cut(targets.join(length_quotas(targets, candidates, context, need), [*context, "target_length"]))
    placed = position_by_ring(candidates, keys, "candidate_ring", ["candidate_id"], "place")
    starts = ring_starts(lines, candidates, keys, "target_ring", "candidate_ring")
    steps = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)))
    steps = steps.withColumn("place", F.pmod(F.col("start") + F.col("step"), F.col("ring_size")))
    found = steps.join(placed, [*keys, "place"]).drop("start", "step", "place", "quota", "ring_size")
    return found.withColumns({
        "gap": F.abs(F.col("candidate_length") - F.col("target_length")),
        "ring_gap": ring_distance(F.col("candidate_ring"), F.col("target_ring")),
    })


def rank_found(found: DataFrame, by: list[str], excluded: Column, take: int) -> DataFrame:
    """The ``take`` nearest candidates per target that are not excluded, by (gap, ring gap)."""
    order = Window.partitionBy(*by).orderBy("gap", "ring_gap", "candidate_id")
    return found.where(~excluded).withColumn("_pick", F.row_number().over(order)).where(F.col("_pick") <= take).drop("_pick")


def candidate_pools(targets: DataFrame, catalog: DataFrame, context: list[str], size: int, seed: int,
                    scope: Column | None = None) -> DataFrame:
    """Pool of ``size``: the positive, the designated donor text if any, and the nearest others, in a second seeded order.

    targets: target_id, positive_id, context, target_length and optionally donor_candidate_id (NULL for none).
    catalog: candidate_id, context, candidate_length. ``scope`` is an optional column that joins the hash parts
    (fold-local pools). Forced candidates and survivors meet in one group per target, ranked and shown there.
    """
    keys = list(targets.columns)
    forced = [c for c in ("positive_id", "donor_candidate_id") if c in keys]
    parts = [] if scope is None else [scope]
    found = nearest_candidates(targets.withColumn("target_ring", _ring(seed, *parts, F.col("target_id"))),
                               catalog.withColumn("candidate_ring", _ring(seed, *parts, F.col("candidate_id"))),
                               context, size - 1 + len(forced))
    is_forced = F.lit(False)
    for column in forced:
        is_forced = is_forced | F.col("candidate_id").eqNullSafe(F.col(column))
    others = found.where(~is_forced).select(*keys, "candidate_id", "candidate_length", "gap", "ring_gap", F.lit(1).alias("_class"))
    must = targets.withColumn("candidate_id", F.explode(F.array_compact(F.array(*forced))))
    must = must.join(catalog.select(*context, "candidate_id", "candidate_length"), [*context, "candidate_id"])
    must = must.withColumns({"gap": F.abs(F.col("candidate_length") - F.col("target_length")), "ring_gap": F.lit(0).cast("bigint"),
                             "_class": F.lit(0)})
    by = _pool_key(targets)
    nearest = Window.partitionBy(*by).orderBy("_class", "gap", "ring_gap", "candidate_id")
    pool = must.select(*others.columns).unionByName(others).withColumn("_pick", F.row_number().over(nearest))
    pool = pool.where(F.col("_pick") <= size).drop("_pick", "_class", "ring_gap")
    pool = pool.withColumn("is_positive", (F.col("candidate_id") == F.col("positive_id")).cast("int"))
    if "donor_candidate_id" in forced:
        pool = pool.withColumn("is_donor_text", F.col("candidate_id").eqNullSafe(F.col("donor_candidate_id")).cast("int"))
    return display_order(pool, by, seed, parts)


def _pool_key(targets: DataFrame) -> list[str]:
    return [c for c in ("outer_fold", "partition", "target_id") if c in targets.columns]


def _ring(seed: int, *parts) -> Column:
    return ring_hash(seed, *parts, "pool-select")


def display_order(pool: DataFrame, by: list[str], seed: int, scope: list | None = None) -> DataFrame:
    """0-based ``candidate_rank`` by a seeded digest of target and candidate."""
    digest = stable_hash(seed, *(scope or []), F.col("target_id"), F.col("candidate_id"), "pool-order")
    order = Window.partitionBy(*by).orderBy("_show", "candidate_id")
    return (pool.withColumn("_show", digest)
            .withColumn("candidate_rank", F.row_number().over(order) - 1).drop("_show"))


def pool_sweep(targets: DataFrame, catalog: DataFrame, context: list[str], sizes: list[int]) -> DataFrame:
    """Pools of several sizes from one ranking; ties in length go by candidate id, the positive sits in the middle.

    Hot lengths are cut into buckets at ids drawn from the catalogue itself, so ids of any form spread over the tasks.
    """
    need = max(sizes)
    keys = [*context, "candidate_length"]
    lines = targets.join(length_quotas(targets, catalog, context, need), [*context, "target_length"])
    placed = prefix_sum(with_id_bucket(catalog, context, "candidate_id"), keys, F.col("_range"), ["candidate_id"], F.lit(1), "place").drop("_range")
    steps = lines.withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota").cast("bigint") - 1)))
    found = steps.join(placed, [*keys, "place"]).withColumn(
        "gap", F.abs(F.col("candidate_length") - F.col("target_length")))
    order = Window.partitionBy("target_id").orderBy("gap", "candidate_id")
    ranked = found.where(F.col("candidate_id") != F.col("positive_id")).withColumn("pick", F.row_number().over(order))
    ranked = ranked.select("target_id", "candidate_id", "pick")
    sized = ranked.withColumn("pool_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    sized = sized.where(F.col("pick") < F.col("pool_size"))
    middle = F.floor(F.col("pool_size") / 2)
    others = sized.select(
        "pool_size", "target_id", "candidate_id", F.lit(0).alias("is_positive"),
        (F.col("pick") - 1 + (F.col("pick") - 1 >= middle).cast("int")).cast("int").alias("candidate_rank"))
    own = targets.withColumn("pool_size", F.explode(F.array(*[F.lit(s) for s in sizes]))).select(
        "pool_size", "target_id", F.col("positive_id").alias("candidate_id"), F.lit(1).alias("is_positive"),
        middle.cast("int").alias("candidate_rank"))
    return own.unionByName(others)


ID_EDGES = 1024


def with_id_bucket(df: DataFrame, context: list[str], key: str) -> DataFrame:
    """Adds ``_range``, which follows the order of ``key`` within the context: the number of edges at or below it.

    Edges are about ``ID_EDGES`` of the context's own ids, those first in hash order. They only steer the work.
    """
    ring = ring_hash(F.col(key), "edge")
    sizes = df.groupBy(*context).agg(F.count("*").alias("_n")) if context else df.agg(F.count("*").alias("_n"))
    counted = df.select(*context, key).join(sizes, context) if context else with_totals(df.select(key), sizes)
    few = counted.where(ring <= F.lit(float(1 << 60)) * ID_EDGES / F.col("_n"))
    edges = F.array_sort(F.collect_set(key)).alias("_edges")
    edged = df.join(few.groupBy(*context).agg(edges), context, "left") if context else with_totals(df, few.agg(edges))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range((8 * ID_EDGES).bit_length()))])
    found = F.aggregate(halves, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get("_edges", at + step - 1) <= F.col(key), F.lit(False)), at + step).otherwise(at))
    edged = edged.withColumn("_range", found)
    return edged.drop("_edges")


def matched_donors(trials: DataFrame, context: list[str], seed: int, rule: str, by_length: bool = True) -> DataFrame:
    """A wrong trial per target: same context, other text, nearest length.

    Two steps so that a text read by a third of all trials stays cheap: the donor *text* is the nearest other text
    on the text ring, the donor *trial* is the next trial of that text on the trial ring.
    trials: trial_id, text_key, length, context. A target without any other text in its context gets no row.
    """
    length = F.col("length") if by_length else F.lit(0).cast(trials.schema["length"].dataType)
    base = trials.select(*context, "trial_id", "text_key", length.alias("length"))
    scope = [F.concat_ws("|", *context)] if context else []
    if not context:
        context, base = ["_all"], base.withColumn("_all", F.lit(0))
    text_ring = ring_hash(seed, *scope, F.col("candidate_id"), rule, "text")
    texts = (base.groupBy(*context, F.col("text_key").alias("candidate_id"))
             .agg(F.min("length").alias("candidate_length"), F.count("*").alias("readers"))
             .withColumn("candidate_ring", text_ring))
    targets = base.select(*context, F.col("trial_id").alias("target_id"), "text_key",
                          F.col("length").alias("target_length"),
                          ring_hash(seed, F.col("trial_id"), rule).alias("target_ring"))
    found = nearest_candidates(targets, texts, context, 2)
    chosen = rank_found(found, [*context, "target_id"], F.col("candidate_id") == F.col("text_key"), 1)
    chosen = cut(chosen.select(*context, "target_id", "target_length", "target_ring", "candidate_length", "gap", "readers",
                               F.col("candidate_id").alias("text_key")))
    member_key = [*context, "text_key"]
    members = base.select(*member_key, F.col("trial_id").alias("donor_id"), ring_hash(seed, F.col("trial_id"), rule).alias("member_ring"))
    placed = position_by_ring(members, member_key, "member_ring", ["donor_id"], "place")
    starts = ring_starts(chosen, members, member_key, "target_ring", "member_ring")
    picks = starts.withColumn("place", F.pmod(F.col("start"), F.col("readers"))).drop("start", "readers")
    out = picks.join(placed.drop("member_ring"), [*member_key, "place"])
    return out.select(
        *[c for c in context if c != "_all"], "target_id", "donor_id", F.col("text_key").alias("donor_text_key"),
        "target_length", F.col("candidate_length").alias("donor_length"), "gap")
