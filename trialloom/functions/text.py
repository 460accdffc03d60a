"""Text expressions: the three normalisations, word counts, cleaning, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from trialloom.functions.fixed_values import MISSING_TOKENS, PROMPT_CLOSING, PROMPT_OPENING, TYPO_BOOK


def words(text: Column) -> Column:
    """Whitespace-separated words, empty ones dropped."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    """Single spaces between words, none around (one code-generated pass, no word list)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapsed_word_count(text: Column) -> Column:
    """Word count of an already collapsed text."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(spaces + 1)


def fold_case(text: Column) -> Column:
    """Identity normalisation: lower case, single spaces."""
    return collapse(F.lower(text))


def replace_in_order(text: Column, pairs) -> Column:
    """Literal replacements one after the other; a later pair sees the result of the earlier ones."""
    return reduce(lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def repair(text: Column) -> Column:
    """Display normalisation: byte-order mark and misprints out, spaces collapsed, case kept."""
    bare = F.replace(clean(text), F.lit("\ufeff"), F.lit(""))
    return collapse(replace_in_order(bare, TYPO_BOOK))


def strip(value: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def clean(value: Column) -> Column:
    """Strip; the missing tokens become NULL."""
    bare = strip(value)
    return F.when(~F.lower(bare).isin(MISSING_TOKENS), bare)


def merge_answer(question: Column, answer: Column) -> Column:
    """Question and answer in one string: the answer fills a trailing '...' or follows a '?'."""
    return (
        F.when(question.isNull(), F.lit(None).cast("string"))
        .when(question.endswith("..."), F.replace(question, F.lit("..."), F.concat(F.lit(" "), answer)))
        .when(question.endswith("?"), F.concat_ws(" ", question, answer))
        .otherwise(F.raise_error(F.concat(F.lit("question without answer slot: "), question)))
    )


def after_marker(text: Column, marker: str = "Target:") -> Column:
    """Text behind the last marker, stripped; NULL becomes the empty string."""
    return strip(F.substring_index(F.coalesce(text, F.lit("")), marker, -1))


def prompt(kind: str, length: Column, surprisal: Column, sentiment: Column, topic: Column,
           dataset: Column | None = None, task: Column | None = None, subject: Column | None = None) -> Column:
    """Prompt sentence list; ``kind`` names the optional clauses ('default' has them all)."""
    clauses = {
        "length": F.format_string("The length of the sentence is %.1f words.", length.cast("double")),
        "surprisal": F.format_string("The average surprisal value is %.2f.", surprisal.cast("double")),
        "sentiment": F.format_string("Sentiment: %s.", sentiment),
        "topic": F.format_string("Topic: %s.", topic),
    }
    parts = [F.lit(PROMPT_OPENING)]
    parts += [clause for name, clause in clauses.items() if "default" in kind or name in kind]
    if dataset is not None:
        parts.append(F.format_string("This EEG signal comes from %s %s subject %s.", dataset, task, subject))
    return F.concat_ws(" ", *parts, F.lit(PROMPT_CLOSING))
