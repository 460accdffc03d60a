"""Small awkward tables: nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import random

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=1):
    """(doc_id, text): prose, near copies around the thresholds, copies in number, short, empty and null texts."""
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(40):
        base = sentence(rng, rng.choice([3, 12, 60, 200, 400])).split()
        for edits in (0, 1, 2, 4, 9):
            copy = list(base)
            for _ in range(edits if rng.random() < 0.7 else 0):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append((n, " ".join(copy)))
            n += 1
    hot = sentence(rng, 150)
    for i in range(120):
        out.append((n, hot))
        n += 1
    passage = sentence(rng, 120)
    for i in range(60):  # share most words, link with few
        out.append((n, passage + " " + sentence(rng, rng.choice([10, 25, 60]))))
        n += 1
    hub = sentence(rng, 300).split()
    for i in range(90):  # near copies of one text, not all near to each other
        copy = list(hub)
        for _ in range(6):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        out.append((n, " ".join(copy)))
        n += 1
    for text in (None, "", "   ", "One", "one", "ONE two", "é É", "one two three", " one\ttwo\nthree "):
        out.append((n, text))
        n += 1
    out.append((n, sentence(rng, 30_000)))
    return out


def frame(spark, rows, extra=True):
    """documents with the usual columns, others that clash with inner names, and a repeated row."""
    full = [(i, t, ["en", "de"][(i or 0) % 2], "src0", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("node", "items", "words", "rank", "length", "w", "start", "n", "body", "value", "score"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(name))
    return df


def crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
