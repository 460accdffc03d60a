"""The registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))
SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_warc_round_trip", "op6_line_dedup", "op7_exact_topk", "op8_benchmark_decontamination"])
def test_matches_sql(spark, name):
    from check import compare, duck
    from trialloom.llm.queries import ORACLES, QUERIES

    line = compare(spark, duck(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert line.startswith("OK"), line


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline
    from test_dedup import brute_lines, groups
    from test_text_ops import check_places, leaks

    from trialloom.session import cut

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = cut(stage(spark, docs, SF_DIR))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert after == before  # every document of the fixture is in a known language
        elif name == "line_dedup":
            lines = {i: (t, n, gone) for i, t, n, gone in brute_lines(before.items())}
            assert after == {i: t for i, (t, n, gone) in lines.items() if gone < n}
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in groups(list(before.items()), 5, 80, 100).items() if i == c}
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, w in leaks(before.items(), items).items() if not w[4]}
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(before)
            n = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
            assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
        docs = out


def test_every_operator_is_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
