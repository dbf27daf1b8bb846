"""Queries that write to the shared folder run where a cluster names it by the path of a mount."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.conf import RuntimeConfig

import __spark_entry__ as repo

WORDS = "the quick brown fox jumps over a lazy dog and runs away from cold rain to its warm dry den".split()
QUERIES = [
    "bigram_counts",
    "byte_level_documents",
    "chunk_cap_100",
    "comma_csv_roundtrip",
    "chunk_cap",
    "compare_tokens",
    "csv_roundtrip",
    "corpus_ppl",
    "dense_index_text_key",
    "leak_passages",
    "events_describe",
    "leaked_items",
    "lookup_hot_keys",
    "legacy_corpus_capped",
    "model_compare",
    "padding_waste",
    "parquet_roundtrip",
    "pad_dynamic",
    "ppl_describe",
    "pseudo_ppl_token",
    "pseudo_ppl_batch4",
    "quantiles_by_ranges",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    texts = [" ".join(WORDS[i % 7 :] * (1 + i % 3)) + f" number{i % 5}." for i in range(40)]
    made = {
        "documents": {
            "doc_id": [*range(40)],
            "text": texts,
            "lang": ["en", "de"] * 20,
            "source": ["web", "web", "book", "news"] * 10,
            "n_chars": [*map(len, texts)],
        },
        "benchmark": {"item_id": [0, 1], "text": [texts[3], " ".join(reversed(WORDS))]},
        "conversations": {"conv_id": [0, 0, 1], "turn": [0, 1, 0], "role": ["user", "assistant", "user"], "text": texts[:3]},
        "events": {"event_id": [*range(40)], "event_type": ["view", "buy"] * 20, "value": [i / 4 for i in range(40)]},
    }
    for name, columns in made.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_writes_to_a_mount_of_the_cluster(spark, tables, tmp_path, monkeypatch, name):
    get = RuntimeConfig.get

    def named(self, key, *default):
        return str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *default)

    monkeypatch.setattr(RuntimeConfig, "get", named)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert repo.queries()[name](spark, tables).count() > 0
    assert any(p.suffix in (".parquet", ".csv") or p.parent.name.startswith("mail-") for p in Path(tmp_path).rglob("*"))
