"""The thin queries: their columns, and SQL where there is some, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerline.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations")
COLUMNS = {
    "op1_pii": ["doc_id", "text", "n_entities", "kinds"],
    "op2_quality_nbsvm": ["doc_id", "held_out", "score", "predicted"],
    "op3_top_k": ["query_id", "rank", "vec_id", "score"],
    "op4_decontaminate": ["doc_id", "item_id", "edits", "similarity", "end_word"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op11_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_unopened"],
    "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_names():
    assert set(registry.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name]
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            path = f"{SF}/{t}.parquet"
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
        got = c.execute(registry.ORACLE_SQL[name])
        order = [[x[0] for x in got.description].index(k) for k in df.columns]
        near = lambda r: tuple(round(v, 4) if isinstance(v, float) else v for v in r)
        assert sorted(map(near, rows), key=repr) == sorted((near([r[k] for k in order]) for r in got.fetchall()), key=repr)
    elif name not in ("op3_top_k", "op12_centroids", "op4_decontaminate"):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
