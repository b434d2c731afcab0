"""Every registered query by name: columns in their order, types, one row where the contract says so."""

import pytest

from __spark_entry__ import queries

COLUMNS = {
    "op1_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}
TABLES = {"op5_chat_format": None, "op9_html_extraction": "pages", "op11_source_divergence": None, "op13_lexical_search": None}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = queries()[name](spark, small)
    wanted = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert df.dtypes[: len(wanted)] == wanted
    rows = df.collect()
    table = TABLES.get(name, "documents")
    key = df.columns[0]
    if table:
        ids = [r[key] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect()]
        assert sorted(r[key] for r in rows) == sorted(ids)
    else:
        assert rows


def test_all_thirteen_and_the_pipeline_are_registered():
    names = queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
