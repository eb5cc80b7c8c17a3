"""Text of values that round to minus zero, lie half-way or are not finite, against the queries' SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sensorloom.queries import ORACLES, QUERIES

ODD = [-0.00003, -0.0, 0.0, 0.03125, -0.03125, -0.00005, 0.00005, 123456.03, float("inf"), float("-inf"), float("nan")]


@pytest.mark.parametrize("name", ["parse_debug", "target_tail", "text_records", "text_templates", "parse_named", "parse_sequential"])
def test_texts_of_odd_values(spark, tmp_path, name):
    rows = [(i, i % 3, [ODD[(i + j * (1 + i // 60)) % len(ODD)] for j in range(64)]) for i in range(240)]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.float32())))]
    pq.write_table(pa.table(dict(zip(("vec_id", "label", "embedding"), columns, strict=True))), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = [tuple(map(repr, r)) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(tuple(map(repr, r)) for r in con.execute(ORACLES[name]).fetchall())
