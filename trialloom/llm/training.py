"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def held_out(doc_id: Column, ways: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``ways``, is ``rest``; a row without an id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(ways)) == rest, F.lit(False))


def sample_order(doc_id: Column) -> Column:
    """An order of rows that has nothing to do with their content."""
    return F.xxhash64(F.lit("llm-sample"), doc_id)
