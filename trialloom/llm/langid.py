"""Language identification by word-first backoff.

Every language gets the log frequency of its words. A text's score in a language is the sum over its words: a known
word counts with its frequency there; a word that no language knows falls back to its longest character n-grams that
are known, and to shorter ones where none is. The language with the largest sum wins (ties: the first by name).

* Words are runs of letters of the lower-cased text; bytes outside ASCII count as letters. ``und`` with score 0 goes to
  texts that are null, empty or without a letter.
* Training counts words on Spark. ``MAX_TRAIN`` bounds the labelled rows a model is fitted on, ``MAX_WORDS`` and
  ``MAX_GRAMS`` the size of the model that is sent to the executors, in equal quotas for each language; every text is scored whole.
* The score is the winner's share of exp(mean log frequency x ``SHARPNESS``) over all languages: between 0 and 1.
* Nulls: a row with null text or language trains nothing. Repeated rows count each. Empty training tables give a model
  without languages, with which every text is ``und``. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from trialloom.llm.training import held_out, sample_order
from trialloom.llm.words import LETTERS, find_words, mix, slices
from trialloom.session import cut, in_small_batches

MAX_TRAIN = 40_000
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
MAX_LANGUAGES = 500
LONGEST_GRAM = 5
SHARPNESS = 4.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of ``labelled`` (text, lang): counted per batch first, then by Spark."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = find_words(_lowered(part.column("text")), LETTERS)
            langs = part.column("lang").dictionary_encode()
            codes = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(found.bounds))
            _, first, counts = np.unique(found.hashes() ^ mix(codes + np.uint64(1)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(codes[first].astype(np.int64))),
                pa.array([found.text(i) for i in first], pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    counted = in_small_batches(labelled.select("text", "lang")).mapInArrow(per_batch, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log frequencies, one column per language: of words by their hash, of n-grams by theirs for each n."""

    languages: list[str]
    words: np.ndarray
    word_logs: np.ndarray
    grams: dict[int, np.ndarray]
    gram_logs: dict[int, np.ndarray]


def word_grams(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash) of every n-gram of characters, from a begin mark to an end mark; single ones without."""
    text = b"".join(b"\x02" + w + b"\x03" for w in words).decode("utf-8", "replace")
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    of = np.cumsum(chars == 2) - 1
    if len(chars) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = len(chars) - n + 1
    inside = of[:size] == of[n - 1:]
    if n == 1:
        inside = chars > 3
    where = np.flatnonzero(inside)
    hashes = np.full(len(where), n, np.uint64)
    for j in range(n):
        hashes = mix(hashes + chars[where + j])
    return of[where], hashes


def _logs(table: np.ndarray, smoothing: float) -> np.ndarray:
    totals = table.sum(axis=0, keepdims=True)
    return np.log((table + smoothing) / (totals + smoothing * max(1, len(table)))).astype(np.float32)


def build_model(rows: list[tuple[str, bytes, int]], max_grams: int = MAX_GRAMS) -> Model:
    """A model from (lang, word, n) rows, which ``train`` has bounded."""
    languages = sorted({r[0] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    words = sorted({r[1] for r in rows})
    number = {w: i for i, w in enumerate(words)}
    table = np.zeros((len(words), len(languages)))
    for lang, word, n in rows:
        table[number[word], place[lang]] += n
    hashes = find_words(pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), LETTERS).hashes()
    order = np.argsort(hashes)
    keys, sums = [], []
    for n in range(1, LONGEST_GRAM + 1):
        of, grams = word_grams(words, n)
        unique, inverse = np.unique(grams, return_inverse=True)
        by_language = [np.bincount(inverse, table[of, c], len(unique)) for c in range(len(languages))]
        total = np.stack(by_language, axis=1) if languages else np.zeros((0, 0))
        keys.append(unique)
        sums.append(total)
    every = np.concatenate(sums) if languages else np.zeros((0, 1))
    quota = max(1, max_grams // max(1, len(languages)))
    least = np.array([max(1.0, np.sort(c)[-quota]) if len(c) > quota else 1.0 for c in every.T])
    kept = [(s >= least).any(axis=1) for s in sums]  # a language's own quota, and all that tie with its last one
    return Model(languages, hashes[order], _logs(table, 0.1)[order],
                 {n: k[m] for n, (k, m) in enumerate(zip(keys, kept), 1)},
                 {n: _logs(s[m], 0.5) for n, (s, m) in enumerate(zip(sums, kept), 1)})


def sampled(usable: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, text, lang) in hash order: by the id, then by text and language. Rows that still tie are the
    same row, of which as many are taken as there is room for; null and repeated ids are like any other."""
    if usable.count() <= most:
        return usable
    keyed = usable.withColumn("_key", F.struct(sample_order(F.col("doc_id")).alias("id"), F.xxhash64("text", "lang").alias("row")))
    # only hashes are ordered; texts stay where they are
    last = keyed.select("_key").orderBy("_key").limit(most).agg(F.max("_key").alias("k"), F.count("*")).select("k.*").first()
    edge = F.struct(F.lit(last["id"]).alias("id"), F.lit(last["row"]).alias("row"))
    below = keyed.where(F.col("_key") < edge)
    room = most - below.count()
    return below.drop("_key").unionByName(keyed.where(F.col("_key") == edge).drop("_key").limit(room))


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fits on at most ``max_train`` rows of (doc_id, text, lang), taken in hash order. Every language has the same quota of its
    own most frequent words and n-grams, so a small language never loses them to large ones."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = cut(count_words(sampled(usable, max_train)))
    languages = counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    quota = max(1, max_words // max(1, languages))
    # how many words of a language have which count: levels from the top on until the quota is full, the last one by a hash
    sizes = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    above = F.coalesce(F.sum("words").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = sizes.withColumn("share", F.least(F.lit(1.0), (quota - above) / F.col("words"))).where("share > 0").drop("words")
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # every level has a word, so there are at most max_words levels
    most = counts.join(F.broadcast(levels), ["lang", "n"]).where(place < F.col("share")).select("word").distinct()
    found = counts.join(most, "word").toArrow()  # about max_words words, each in some of the languages
    rows = list(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n"))))
    return build_model(rows, max_grams)


class Scorer:
    """Scores batches of texts."""

    def __init__(self, model: Model):
        self.model = model

    def backoff(self, words: list[bytes]) -> np.ndarray:
        """Rows of unseen words: the mean over their known n-grams of the largest n that has any."""
        rows = np.zeros((len(words), len(self.model.languages)))
        open_words = np.arange(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(open_words) or not len(self.model.grams[n]):
                continue
            of, hashes = word_grams([words[i] for i in open_words], n)
            at = np.minimum(np.searchsorted(self.model.grams[n], hashes), len(self.model.grams[n]) - 1)
            known = self.model.grams[n][at] == hashes
            of, at = of[known], at[known]
            counts = np.bincount(of, minlength=len(open_words))
            if not len(of):
                continue
            met = np.flatnonzero(counts)
            firsts = np.searchsorted(of, met)
            rows[open_words[met]] = np.add.reduceat(self.model.gram_logs[n][at].astype(float), firsts, axis=0) / counts[met, None]
            open_words = open_words[counts == 0]
        return rows

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, model = len(texts), self.model
        labels, scores = [UNKNOWN] * n, np.zeros(n)
        if not model.languages or not n:
            return labels, scores
        found = find_words(_lowered(texts), LETTERS)
        if not len(found.start):
            return labels, scores
        unique, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(model.words, unique), len(model.words) - 1)
        known = model.words[at] == unique
        rows = model.word_logs[at].astype(float)
        rows[~known] = self.backoff([found.text(i) for i in first[~known]])
        filled = np.flatnonzero(np.diff(found.bounds) > 0)
        sums = np.zeros((n, len(model.languages)))
        sums[filled] = np.add.reduceat(rows[inverse], found.bounds[filled], axis=0)
        means = sums / np.maximum(1, np.diff(found.bounds))[:, None] * SHARPNESS
        best = means.argmax(axis=1)
        share = 1.0 / np.exp(means - means.max(axis=1, keepdims=True)).sum(axis=1)
        data, bounds = found.data, found.text_bounds
        ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[data] & (data < 128))])
        for i in filled:
            lo, hi = bounds[i], bounds[i + 1]
            if ascii_letters[hi] == ascii_letters[lo] and not _LETTER.search(data[lo:hi].tobytes().decode("utf-8", "replace")):
                continue
            labels[i], scores[i] = model.languages[best[i]], share[i]
        return labels, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS, MAX_GRAMS, MAX_LANGUAGES
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            labels, scores = scorer.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known, with a score of ``least`` or more.

    The score is a share over all languages, so what ``least`` rejects depends on their number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            labels, scores = scorer.predict(part.column("text"))
            kept = np.array([label != UNKNOWN for label in labels]) & (scores >= least)
            yield part.filter(pa.array(kept))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows the query may learn from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), 4, 2))
