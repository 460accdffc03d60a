"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text (split at line feeds) form a window, known by 128 hash bits of its lines. Windows
that occur more than once in the whole table keep their first occurrence, by (doc_id, place); every later one is
covered, and the lines that any covered window holds are removed. The rest of a text is joined again, nothing else of
it changes.

* A window of blank lines only does not count. Texts of fewer than three lines have no window and stay as they are.
* A text inside which a window repeats loses the repeats as well; overlapping covered windows merge.
* Null text: null stays, with 0 lines. Empty text: one empty line. Null doc_id comes first in the order.
* Rows with the same doc_id and the same text are one document: they lose the same lines. Rows with one doc_id and
  several texts are ordered by a hash of the text.
* Other columns pass through ``dedup_lines`` whatever their names; an empty table gives an empty table.

Windows of one hash are never brought together: their first place is a minimum with a map-side part, and the join that
finds the later ones is an equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.llm.graph import free_name
from trialloom.session import cut

SIZE = 3
_SALT = 7919


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(w1, w2, doc_id, body, place): one row per window; ``body`` tells texts of one doc_id apart."""
    line = lambda i: [F.get("lines", i + j) for j in range(size)]
    hashed = lambda i: F.when(
        F.concat(*line(i)).rlike(r"\S"),
        F.struct(F.xxhash64(*line(i)).alias("w1"), F.xxhash64(F.lit(_SALT), *line(i)).alias("w2"), i.alias("place")))
    return (
        docs.where(F.col("text").contains("\n"))
        .select("doc_id", F.xxhash64("text").alias("body"), _lines(F.col("text")).alias("lines"))
        .where(F.size("lines") >= size)
        .select("doc_id", "body", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), hashed)).alias("w"))
        .where("w IS NOT NULL")
        .select("w.w1", "w.w2", "doc_id", "body", "w.place"))


def later_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, body, places): the places of windows that occurred before."""
    all_windows = windows(docs, size)
    firsts = (
        all_windows.groupBy("w1", "w2")
        .agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "body", "place")).alias("first"))
        .where("times > 1").select("w1", "w2", "first"))
    later = all_windows.join(firsts, ["w1", "w2"]).where(
        ~F.struct("doc_id", "body", "place").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "body").agg(F.collect_set("place").alias("places"))


def added_names(docs: DataFrame) -> tuple[str, str, str]:
    """The columns that ``dedup_lines`` adds to ``docs``: ``_lines``, ``_removed`` and ``_spans``, or longer names where these are taken."""
    taken = list(docs.columns)
    out = []
    for name in ("_lines", "_removed", "_spans"):
        out.append(free_name(name, taken + out))
    return tuple(out)


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with texts without their repeated lines.

    Three columns follow those of ``docs``, with the names of ``added_names``: lines before, lines removed, and the merged runs of
    removed lines, as first line and number of lines.
    """
    lines, gone, runs = added_names(docs)
    taken = [*docs.columns, lines, gone, runs]
    every_, starts_, places_, id_, body_ = (free_name(n, taken) for n in ("_every", "_starts", "_places", "_later_id", "_later_body"))
    later = cut(later_windows(docs.select("doc_id", "text"), size)).withColumnsRenamed({"doc_id": id_, "body": body_, "places": places_})
    # the table of repeats grows with the input, so it is never broadcast: cost stays in proportion
    joined = docs.join(later.hint("merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(body_)), "left")
    every = F.when(docs["text"].isNull(), F.array().cast("array<string>")).otherwise(_lines(docs["text"]))
    starts = F.array_sort(F.coalesce(places_, F.array().cast("array<int>")))
    marked = joined.select(docs["*"], every.alias(every_), starts.alias(starts_))
    # a run begins where no window reaches up to it, and ends where the next one begins beyond it
    begins = F.filter(starts_, lambda p, i: (i == 0) | (p - F.get(starts_, i - 1) > size))
    ends = F.transform(
        F.filter(starts_, lambda p, i: (i == F.size(starts_) - 1) | (F.get(starts_, i + 1) - p > size)),
        lambda p: p + (size - 1))
    kept_columns = [F.col(f"`{c}`") for c in docs.columns]
    spans = marked.select(
        *kept_columns, every_, F.zip_with(begins, ends, lambda a, b: F.struct(
            a.alias("line"), (b - a + 1).alias("n"))).alias(runs))
    # what stands before each run, and after the last
    past = lambda j: F.when(j == 0, 0).otherwise(
        F.get(runs, j - 1)["line"] + F.get(runs, j - 1)["n"])
    gaps = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda j: F.slice(
        every_, past(j) + 1, F.coalesce(F.get(runs, j)["line"], F.size(every_)) - past(j)))
    kept = F.when(F.size(runs) == 0, F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    removed = F.aggregate(runs, F.lit(0), lambda total, s: total + s["n"])
    return spans.select(
        *[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(every_).cast("long").alias(lines), removed.cast("long").alias(gone), runs)


def keep_unrepeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with deduped texts; a document all of whose lines are repeats goes."""
    lines, gone, _ = (F.col(c) for c in added_names(docs))
    out = dedup_lines(docs, size)
    return out.where((gone == 0) | (gone < lines)).select(*[f"`{c}`" for c in docs.columns])
