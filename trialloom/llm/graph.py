"""Connected components of links, and joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialloom.session import cut

HEAVY_KEYS = 1024
BROADCAST_IDS = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn until the links are stars; every step is a minimum per node and an equi-join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a, b), b < a, is either the centre of a star or has one link, to a centre."""
    ends = edges.select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("int").alias("up")))
    many = ends.groupBy("a").agg(F.count("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1")
    return many.isEmpty()


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``keyed`` on ``key``, where ``count`` says how many rows a key has.

    Keys with more than a ``HEAVY_KEYS``-th of all counted rows are at most ``HEAVY_KEYS``, so they are broadcast; the rest
    meets by a shuffle in which no key is heavy. ``keyed`` has one row per key; rows with a null key are kept.
    """
    least = (keyed.agg(F.sum(count)).first()[0] or 0) / HEAVY_KEYS
    added = [c for c in keyed.columns if c not in (key, count)]
    heavy = keyed.where(F.col(count) > least).select(key, *added, F.lit(True).alias("_heavy"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    done = marked.where("_heavy").select(*rows.columns, *added)
    apart = marked.where(f"`{key}` IS NULL").select(*rows.columns, *added)
    rest = marked.where(F.col("_heavy").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    light = keyed.where(F.col(count) <= least).select(key, *added).hint("merge")
    return done.unionByName(apart).unionByName(rest.join(light, key, "left").select(*rows.columns, *added))


def with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` whose doc_id is (left_semi) or is not (left_anti) among ``ids``, a table of one column; null equals null.

    The ids are counted: up to ``BROADCAST_IDS`` they are broadcast and the rows stay where they are, beyond that both sides
    are merged by a shuffle.
    """
    name = free_name("_id", rows.columns)
    ids = cut(ids.toDF(name))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return rows.join(ids, rows["doc_id"].eqNullSafe(F.col(name)), how)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column of ``taken`` has it (Spark's names do not tell cases apart)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
