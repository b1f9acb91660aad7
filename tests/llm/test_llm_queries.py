import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import differ

from helixframe.llm.queries import oracle_sql, queries

SMALLEST = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
# The columns of the contracts.
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_html_extraction": "page_id url text n_chars",
    "op3_minhash": "doc_id n_shingles component_id kept",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_toxicity": "doc_id held_out score predicted threshold toxic",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op12_source_divergence": "lang source part item value rank",
    "op10_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differ(spark, queries()[name], oracle_sql()[name], SMALLEST) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_the_columns_and_rows_of_its_contract(spark, name):
    df = queries()[name](spark, SMALLEST)
    assert df.columns == COLUMNS[name].split()
    table = "pages" if name.startswith("op2_") else "documents"
    if name.startswith("op12_"):
        return
    n = spark.read.parquet(f"{SMALLEST}/{table}.parquet").count()
    assert df.count() == n if name != "op9_packing" else df.select("doc_id").distinct().count() == n
