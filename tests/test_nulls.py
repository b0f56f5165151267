"""Every core query over tables with null rows, against its SQL."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerline.plans import registry
from tests.test_queries import SF, TABLES, rows


@pytest.fixture(scope="module")
def with_nulls(tmp_path_factory):
    """The smallest tables, each with a row of nulls and a row of nulls but for its first column."""
    folder, duck = str(tmp_path_factory.mktemp("nulls")), duckdb.connect()
    for name in TABLES:
        t = pq.read_table(f"{SF}/{name}.parquet")
        first = t.column(0).combine_chunks()
        more = {c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names}
        more[t.column_names[0]] = pa.array([None, 10**6], first.type)
        schema = pa.schema([f.with_nullable(True) for f in t.schema])
        pq.write_table(pa.concat_tables([t.cast(schema), pa.table(more, schema=schema)]), f"{folder}/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(folder, name)}.parquet')")
    return folder, duck


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_over_null_rows_matches_sql(spark, with_nulls, name):
    folder, duck = with_nulls
    df = registry.QUERIES[name](spark, folder)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_over_null_rows(spark, with_nulls, name):
    registry.QUERIES[name](spark, with_nulls[0]).collect()
