"""The registered text queries on the smallest tables: columns, rows, and the SQL twins."""

import os

import duckdb
import pytest

from fotoloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_toxicity": "doc_id p_toxic toxic",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_html_text": "page_id url text n_chars",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_decontamination": "doc_id item_id cosine lcs answer",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op13_spelling_variants": "word form root n n_near form_n",
}
ALL_ROWS = {"op1_quality_rules", "op4_simhash", "op6_quality_classifier", "op7_repeats", "op8_sharding", "op10_language_id", "op12_license_scan"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_there_is_one_query_for_each_operator():
    assert sorted(QUERIES) == sorted(COLUMNS) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    assert len(rows) == 200 if name in ALL_ROWS else rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        cursor = con.execute(ORACLE_SQL[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == sorted(map(repr, cursor.fetchall()))
