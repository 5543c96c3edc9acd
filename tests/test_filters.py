"""The filter language on rows with nulls, odd column names and text beyond ASCII."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewell.functions import filters as fl

ROWS = [(1, "active", "urgent 50%_OFF", dt.datetime(2026, 4, 15), 5), (2, None, "Été", dt.datetime(2026, 4, 17, 10, 30, 5), None), (3, "inactive", None, None, -1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, status string, note string, at timestamp_ntz, a__b int")


def ids(df, filters=None, **more):
    return sorted(r.id for r in fl.apply(df, filters, **more).collect())


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, [1, 2, 3]),
        ({"status": "active"}, [1]),
        ({"status": None}, [2]),
        ({"status__ne": "active"}, [3]),
        ({"status__not_in": ["active"]}, [3]),
        ({"status__in": ["active", None]}, [1, 2]),
        ({"status__nin": ["active", None]}, [3]),
        ({"status__in": []}, []),
        ({"status__not_in": []}, [1, 2, 3]),
        ({"status__isnull": True}, [2]),
        ({"note__contains": "50%_"}, [1]),
        ({"note__not_contains": "x"}, [1, 2]),
        ({"note__icontains": "ÉT"}, [2]),
        ({"note__iexact": "été"}, [2]),
        ({"note__iregex": "^urg"}, [1]),
        ({"a__b__gt": 0}, [1]),
        ({"a__b": -1}, [3]),
        ({"id__range": [2, 3]}, [2, 3]),
        ({"at__date": "2026-04-17"}, [2]),
        ({"at__date__lte": dt.date(2026, 4, 15)}, [1]),
        ({"at__date__range": ["2026-04-15", "2026-04-16"]}, [1]),
        ({"at__time__gte": "10:30"}, [2]),
        ({"at__week_day": 2}, [1]),
        ({"at__year__in": [2026]}, [1, 2]),
        ({"at__gt": "2026-04-16"}, [2]),
        ({"at__lte": dt.date(2026, 4, 17)}, [1]),
        ({"$or": [{"id": 1}, {"status": "inactive"}]}, [1, 3]),
        ({"$not": {"status": "active"}}, [3]),
        ({"$and": [{"id__gte": 1}, {"$not": {"id": 2}}]}, [1, 3]),
        ({"$or": [{}, {"id": 1}]}, [1, 2, 3]),
    ],
)
def test_filters(df, filters, want):
    assert ids(df, filters) == want


def test_exclude_and_tuples(df):
    assert ids(df, {"status": "active"}, exclude=True) == [3]
    assert sorted(r.id for r in fl.apply(df, fl.parse_tuples([[("id", "=", 1)], [("id", ">", 2)]])).collect()) == [1, 3]


@pytest.mark.parametrize("bad", [{"id__nope": 1}, {"no_such": 1}, {"$or": []}, {"$xor": [{}]}, {"id__range": [1]}, {"id__in": "abc"}, {"note__regex": "(a+)+"}, {"note__regex": "("}, {"note__regex": "x" * 501}])
def test_bad_filters(df, bad):
    with pytest.raises(fl.FilterError):
        fl.apply(df, bad)


def test_scan_gets_the_filter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = fl.apply(df, o_orderdate__date__lte="1996-01-01", o_orderkey__gt=5).select("o_orderkey")._jdf.queryExecution().toString()
    scan = plan[plan.rindex("PushedFilters: [") :]
    assert "LessThan(o_orderdate" in scan and "GreaterThan(o_orderkey,5)" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in scan
