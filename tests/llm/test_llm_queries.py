"""Operator queries against their SQL, and all of them for shape, on the smallest tables."""

import pytest
from oracle import TABLES, both

from marlstone.llm import registry

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")
COLUMNS = {
    "op1": {"doc_id", "held_out", "score", "predicted"},
    "op2": {"query_id", "rank", "vec_id", "score"},
    "op3": {"page_id", "host", "path", "rule", "verdict"},
    "op4": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5": {"doc_id", "n_shingles", "component_id", "kept"},
    "op6": {"doc_id", "log_likelihood"},
    "op7": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op8": {"doc_id", "copies"},
    "op9": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op11": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op12": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    ours, theirs = both(spark, registry.queries()[name], registry.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_shape(spark, name):
    df = registry.queries()[name](spark, str(TABLES))
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    if name.split("_")[0] in ("op1", "op5", "op6", "op7", "op8", "op9", "op11", "op13"):
        assert df.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
