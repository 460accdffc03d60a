"""Benchmark decontamination with a broadcast set of word n-grams, in DataFrame functions only.

Both sides lower-case A-Z and take runs of letters, digits and bytes outside ASCII as words. A benchmark item gives its
windows of ``size`` consecutive words; an item of fewer words, but not none, is one window as a whole. Every window of
every text is looked up by hash in the windows of the benchmark, and a hit counts only if the words are the same.

* The set is broadcast only while its size, which is measured first, is within ``BROADCAST_BYTES``. A larger benchmark is
  dealt by hash into blocks of at most about that size and the texts are scanned once per block; the result is the same.
* Null or wordless texts have 0 words and no hit; null items and items without words give no window. Repeated rows
  each get their result; items that share a window are all named. Rows of one doc_id and text are scanned together.
* An empty benchmark contaminates nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.session import cut

SIZE = 10
BROADCAST_BYTES = 32 << 20
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; an empty array if it is null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    spaced = F.trim(F.regexp_replace(low, _NO_WORD, " "))
    return F.when(text.isNull() | (spaced == ""), F.array().cast("array<string>")).otherwise(F.split(spaced, " ", -1))


def _joined_grams(hashes: Column, apart: int) -> Column:
    """Hashes of (h[i], h[i + apart]) for all i; shorter by ``apart``."""
    n = F.size(hashes) - apart
    left, right = F.slice(hashes, 1, F.greatest(n, F.lit(0))), F.slice(hashes, apart + 1, F.greatest(n, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def gram_steps(df: DataFrame, size: int, word_column: str, out: str) -> DataFrame:
    """Adds ``out``: the hashes of all windows of ``size`` words, built by doubling (1, 2, 4, ... words)."""
    df = df.withColumn("_g1", F.transform(word_column, lambda w: F.xxhash64(w)))
    have, spans = {1: "_g1"}, 1
    while spans * 2 <= size:
        df = df.withColumn(f"_g{spans * 2}", _joined_grams(F.col(f"_g{spans}"), spans))
        spans *= 2
        have[spans] = f"_g{spans}"
    done, current = spans, F.col(f"_g{spans}")
    rest = size - spans
    while rest:
        step = max(k for k in have if k <= rest)
        n = F.greatest(F.size(current) - step, F.lit(0))
        current = F.zip_with(F.slice(current, 1, n), F.slice(F.col(have[step]), done + 1, n), lambda a, b: F.xxhash64(a, b))
        done, rest = done + step, rest - step
    return df.withColumn(out, current).drop(*[c for c in have.values() if c != out])


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(n, gram, items): the distinct windows with the ids, as text, of the items they stand in."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(
        F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    grams = item.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    return grams.groupBy("n", "gram").agg(F.collect_set("item").alias("items"))


def _window_hash(benchmark_grams: DataFrame, sizes: list[int]) -> DataFrame:
    """The hash that a window has in a text's scan."""
    parts = []
    for n in sizes:
        one = gram_steps(benchmark_grams.where(F.col("n") == n), n, "gram", "_h")
        parts.append(one.select("n", "gram", "items", F.get("_h", F.lit(0)).alias("h")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, body, start, n, items): verified windows; ``body`` is a hash of the text, ``start`` counts from 0."""
    grams = cut(item_windows(benchmark, size))
    bytes_of = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " ")) + 200
    measured = grams.groupBy("n").agg(F.sum(bytes_of).alias("bytes")).collect()  # a row per window size, ``size`` at most
    sizes = sorted(r.n for r in measured)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, body binary, start int, n int, items array<string>")
    blocks = max(1, math.ceil(sum(r.bytes for r in measured) / broadcast_bytes))
    hashed = _window_hash(grams, sizes)

    scan = docs.where(F.length("text") > 0).select("doc_id", F.unhex(F.md5("text")).alias("body"), words(F.col("text")).alias("w"))
    for n in sizes:
        scan = gram_steps(scan, n, "w", f"_h{n}")
    every = F.concat(*[f"_h{n}" for n in sizes]) if len(sizes) > 1 else F.col(f"_h{sizes[0]}")
    # outer: an inner explode would have its whole input computed a second time, to filter out empty arrays
    scanned = scan.select("doc_id", "body", "w", F.posexplode_outer(every).alias("at", "h"))
    # where the windows of each size begin in the joined array
    before, offset = F.lit(0), {}
    for n in sizes:
        offset[n] = before
        before = before + F.greatest(F.size("w") - (n - 1), F.lit(0))
    start = F.col("at") if len(sizes) == 1 else F.col("at") - F.coalesce(
        *[F.when(F.col("n") == n, offset[n]) for n in sizes])
    found = None
    for block in range(blocks):
        wanted = hashed if blocks == 1 else hashed.where(F.pmod(F.hash("h"), F.lit(blocks)) == block)
        hit = (scanned.join(F.broadcast(wanted), "h")
               .select("doc_id", "body", start.alias("start"), "n", "gram", "items", "w")
               .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("w")))
               .where(F.slice("w", F.col("start") + 1, F.col("n")) == F.col("gram"))
               .select("doc_id", "body", "start", "n", "items"))
        found = hit if found is None else found.unionByName(hit)
    return found


def _covered(hits: Column) -> Column:
    """How many words the windows (start, n) cover: sorted by start, each adds what lies beyond those before."""
    step = F.aggregate(
        F.array_sort(hits), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("total")))
    return step["total"]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    hits = find_hits(docs, benchmark, size, broadcast_bytes)
    per_doc = hits.groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).agg(
        F.collect_set(F.struct("start", "n")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    body = F.unhex(F.md5("text"))
    counted = docs.select("doc_id", body.alias("body"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(per_doc, counted["doc_id"].eqNullSafe(per_doc["_id"]) & (counted["body"] == per_doc["_body"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.size("spans") > 0, F.lit(False)).alias("contaminated"),
        F.array_sort(F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>"))).alias("spans"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, size)
    dirty = cut(hits.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct())
    clean = docs.join(dirty.hint("merge"), docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.unhex(F.md5(docs["text"])) == dirty["_body"]),
                      "left_anti")
    return clean
