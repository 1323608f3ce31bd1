"""The thin queries: contracts, and their SQL where SQL can express them."""

import pytest

from siltstone.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_multiindex": "vec_id n_links component_id kept",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_multiset": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_quality": "doc_id held_out score predicted",
    "op6_substring": "doc_id n_words n_removed kept_sha256",
    "op7_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_wrapper": "page_id url text n_chars",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert differences(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF, connect(SF)) is None


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if name not in ("op4_packing", "pipeline"):
        table = {"op1": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
        want = spark.read.parquet(f"{SF}/{table}.parquet").count() if name != "op7_chat" else spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
        assert df.count() == want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.queries()) == set(COLUMNS) <= set(entry.queries())
