"""The queries op11 to op13 over whole tables, against SQL or brute force."""

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))
SF_DIR = "/root/testdata/sf0.001"


def test_filter_audit_matches_sql(spark):
    from check import compare, duck
    from trialloom.llm.queries import ORACLES, QUERIES

    name = "op13_filter_interaction_audit"
    line = compare(spark, duck(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert line.startswith("OK"), line


def test_simhash_groups_of_documents(spark):
    from test_simhash import expected
    from trialloom.llm.queries import op11_simhash_near_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = op11_simhash_near_dedup(spark, SF_DIR).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(rows)


def test_repairs_of_conversations(spark):
    from test_conversations import brute, collected, damage, hash_order
    from trialloom.llm.queries import op12_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept = damage(rows)
    assert collected(op12_conversation_repair(spark, SF_DIR)) == brute(kept, {r[0] for r in rows}, hash_order(spark, kept))


def test_all_thirteen_are_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
