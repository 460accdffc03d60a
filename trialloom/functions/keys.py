"""Identities: stable digests, trial ids, cohorts, strata (Column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trialloom.functions.fixed_values import LENGTH_STRATA

UNIT = "\x1f"
RING = 1 << 60
#: leaves the leading eight bits of a ring hash
HASH_SHIFT = 52


def _part(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def stable_hash(*parts) -> Column:
    """SHA-256 hex of the parts joined by the unit separator. Parts: columns (string or integer) or literals."""
    return F.sha2(F.concat_ws(UNIT, *[_part(p) for p in parts]), 256)


def hex_to_long(digest: Column, digits: int = 15) -> Column:
    """Leading hex digits as a bigint (15 digits stay below 2**60)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def ring_hash(*parts) -> Column:
    """Position of the parts on a ring of 2**60 points."""
    return hex_to_long(stable_hash(*parts))


def ring_distance(candidate: Column, target: Column) -> Column:
    """Clockwise distance from target to candidate."""
    return F.pmod(candidate - target, F.lit(RING))


def draw_hash(*parts) -> Column:
    """Cheaper 60-bit hash for resampling draws (MD5)."""
    return hex_to_long(F.md5(F.concat_ws(UNIT, *[_part(p) for p in parts])))


def uniform(*parts) -> Column:
    """Hash-derived number in [0, 1)."""
    return draw_hash(*parts).cast("double") / F.lit(float(RING))


def trial_id(dataset, task, subject, index) -> Column:
    return F.format_string("%s::%s::%s::row%06d", dataset, task, subject, index)


def candidate_id(dataset: Column, task: Column, text_digest: Column) -> Column:
    return F.concat_ws("::", dataset, task, F.substring(text_digest, 1, 20))


def cohort(dataset: Column, raw_task: Column) -> Column:
    return (
        F.when((dataset == "ZuCo2") & raw_task.isin("task2", "task3"), "primary_zuco2_nr_tsr")
        .when(raw_task == "task1", "auxiliary_sr")
        .otherwise("zuco1_nr_tsr_noncausal")
    )


def length_stratum(length: Column) -> Column:
    """Name of the length bin; a negative length is an error."""
    out = F.when(length < 0, F.raise_error(F.concat(F.lit("negative length: "), length.cast("string"))))
    for upper, name in LENGTH_STRATA:
        out = out.when(F.lit(True) if upper is None else length <= upper, F.lit(name))
    return out


def hash_parity(*parts) -> Column:
    """0 or 1 from the first eight hex digits."""
    return F.pmod(hex_to_long(stable_hash(*parts), 8), F.lit(2)).cast("int")


def hash_seed(*parts) -> Column:
    """64-bit seed of the parts, as decimal(20,0) because it may exceed a signed bigint."""
    return F.conv(F.substring(stable_hash(*parts), 1, 16), 16, 10).cast("decimal(20,0)")
