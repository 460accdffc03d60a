"""The queries opN_<name> of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.llm import conversations, decontam, filteraudit, htmltemplate, langid, licenses, linededup, packing, quality, setsketch, simhash, topk, warc
from trialloom.llm.training import held_out

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file stands; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltemplate.extract(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), 3, 85, 100)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without repeated three-line windows, its lines before and the lines removed."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.search(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    return langid.identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_setsketch_near_dedup": op5_setsketch_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

_LINES = """
WITH lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i AS place, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS body
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM lined)),
solid AS (SELECT * FROM windows WHERE regexp_matches(body, '[^ \\t\\n\\x0B\\f\\r]')),
later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS nth FROM solid) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (SELECT unnest([0, 1, 2]) AS k)),
every_line AS (SELECT doc_id, i AS place, lines[i] AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM lined)),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS text, count(*) AS n
  FROM every_line e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.place = c.place GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(l.lines), 0)::BIGINT AS n_lines, (coalesce(len(l.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed
FROM documents d LEFT JOIN lined l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_LEAKS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM item_words WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM grams),
scanned AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes)),
hits AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM scanned s JOIN grams g ON s.gram = g.gram AND s.n = g.n),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN named m ON w.doc_id = m.doc_id
"""

_NEAREST = """
WITH usable AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_quads = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)"
    for i in range(8) for s in (15, 10, 5, 0))
_CAPTURES = f"""
WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
newest AS (SELECT hex, max(page_id) AS newest FROM bodies GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes, {_quads} AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM bodies JOIN newest USING (hex)
"""

_ORDERS = r"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM base GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > least, false) AS e
  FROM (SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM base)
  JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, if(a, 'A', '') || if(b, 'B', '') || if(c, 'C', '') || if(d, 'D', '') || if(e, 'E', '') AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged_steps AS (
  SELECT c.*, s.*, contains(fails, own) AS failing, len(translate(fails, earlier, '')) < len(fails) AS gone
  FROM cells c, steps s),
shown AS (
  SELECT part, filter_order, step::INTEGER AS step, own, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged_steps GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM shown
"""

ORACLES = {
    "op13_filter_interaction_audit": _ORDERS,
    "op4_warc_round_trip": _CAPTURES,
    "op7_exact_topk": _NEAREST,
    "op6_line_dedup": _LINES,
    "op8_benchmark_decontamination": _LEAKS,
}
