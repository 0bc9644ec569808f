import perigee.plans as plans
import pytest

from conftest import DATA, rows_of

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_ground_tracks_of_all_objects(spark):
    got = plans.queries()["p6_ground_track"](spark, DATA)
    assert got.select("object_id").distinct().count() == spark.read.parquet(f"{DATA}/part.parquet").count()
    assert got.where("alt_km > 30000 and error = 0").count() > 0
    assert got.where("error = 0 and lat is null").count() == 0
