"""Registered queries against their SQL, and the kinds of their columns."""

import duckdb
import pytest

from stallwise.llm.queries import QUERIES, SQL
from tests.compare import differences
from tests.llm.conftest import SF

COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op4_exact_topk": "query_id rank vec_id score",
    "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_html_text": "page_id url text n_chars",
    "op8_quality": "doc_id held_out score predicted",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_vantage_trees": "query_id rank vec_id score",
    "op11_spelling": "word form root n n_near form_n",
    "op12_resampling": "doc_id n_features weight score rank",
    "op13_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_operator_has_a_query():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    if name == "op4_exact_topk":  # the SQL's rank is an integer too
        df, sql = df.withColumn("rank", df["rank"].cast("bigint")), SQL[name].replace("::INTEGER", "::BIGINT")
        assert differences(df, con, sql) == []
    else:
        assert differences(df, con, SQL[name]) == []
