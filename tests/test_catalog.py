"""Every catalogue query against its SQL on the bundled tables."""

import pytest

from palimpsest.plans import catalog
from tests.conftest import DATA, table_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    assert table_of(got) == table_of(duck.execute(catalog.ORACLE[name]).df())


def test_golden_segment_counts(spark):
    assert catalog.track_segments(spark, DATA).count() == 802
    assert catalog.track_frames(spark, DATA).count() == 674


def test_filters_reach_the_scan(spark):
    plan = catalog.score_text_filter(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_direction_sort_keeps_the_sign_of_zero_and_missing_numbers(spark, tmp_path):
    import duckdb

    base = [(i * 37 % 64 - 31) / 100 for i in range(64)]
    put = lambda at: [at.get(i, x) for i, x in enumerate(base)]
    vectors = [put({0: -1e-7, 4: -0.0, 8: 0.0, 12: 1e-7, 16: -5e-7, 20: 5e-7}), [-0.0] * 64, put({2: None}), put({0: None}), put({1: None, 2: None}), put({2: float("nan")}), base[:10], [], None, [None] * 64]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: str(xs) for i, xs in con.execute(catalog.ORACLE["direction_sort"]).fetchall()}
    assert want == {r.vec_id: str(r.xs) for r in catalog.direction_sort(spark, str(tmp_path)).collect()} and len(want) == len(vectors)
