"""A membership means the same for a list of any length and for a frame of its values."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.functions import filters as fl
from tidewell.sources import guard

D, T, N = dt.date, dt.datetime, Decimal
#: Column type, its values, a list, what is in the list.
CASES = [
    ("string", ["007", "7", "8", "7.0", None], [7, 8], ["7", "8"]),
    ("string", ["true", "1.5", "1.0E7", "2024-01-02"], [True, 1.5, 1e7, D(2024, 1, 2)], ["true", "1.5", "1.0E7", "2024-01-02"]),
    ("string", ["2024-01-02 10:00:00", "2024-01-02 10:00:00.5"], [T(2024, 1, 2, 10), T(2024, 1, 2, 10, 0, 0, 500_000)], ["2024-01-02 10:00:00", "2024-01-02 10:00:00.5"]),
    ("int", [7, 8, 9, None], ["7", 8.0, 9.5, N("9.2"), 1 << 80], [7, 8]),
    ("long", [1 << 53, (1 << 53) + 1], [(1 << 53) + 1, 2.5], [(1 << 53) + 1]),
    ("double", [0.1, 0.5, 3.0, None], ["0.5", 3, N("0.1")], [0.1, 0.5, 3.0]),
    ("decimal(10,2)", [N("1.50"), N("2.00"), N("0.10")], [1.5, "2", N("0.101"), 0.1], [N("1.50"), N("2.00"), N("0.10")]),
    ("boolean", [True, False, None], [1, 7], [True]),
    ("boolean", [True, False, None], ["no", "perhaps"], [False]),
    ("date", [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 4), None], [T(2024, 1, 2, 10), T(2024, 1, 3), "2024-1-4", "2024-01-02 11:00:00"], [D(2024, 1, 3), D(2024, 1, 4)]),
    ("timestamp_ntz", [T(2024, 1, 2), T(2024, 1, 2, 10), None], [D(2024, 1, 2), "2024-01-02T10:00:00"], [T(2024, 1, 2), T(2024, 1, 2, 10)]),
    ("timestamp_ntz", [T(2024, 1, 2), T(2024, 1, 2, 10)], [T(2024, 1, 2, 12, tzinfo=dt.timezone(dt.timedelta(hours=2)))], [T(2024, 1, 2, 10)]),
    ("int", [7, None], [7.5], []),
    ("date", [D(2024, 1, 2), None], [T(2024, 1, 2, 10)], []),
]


def filler(values, n):
    """So many more values of the kind that none of the column's is."""
    v = values[0]
    if isinstance(v, (dt.date, dt.datetime)):
        zone = getattr(v, "tzinfo", None)
        return [T(1900, 1, 1, 3, tzinfo=zone) + dt.timedelta(hours=24 * k) for k in range(n)]
    return [f"{10**7 + k}" for k in range(n)] if isinstance(v, str) else [10**7 + 1 + k for k in range(n)]


def rows(df):
    return sorted((r[0] for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind, column, values, inside", CASES)
def test_short_and_long_lists_agree(spark, kind, column, values, inside):
    df = spark.createDataFrame([(v,) for v in column], f"k {kind}")
    out = [v for v in column if v is not None and v not in inside]
    for n in (0, fl.LONG_LIST - len(values), fl.LONG_LIST + 1 - len(values)):
        given = values + filler(values, n)
        random.Random(n).shuffle(given)
        assert rows(fl.apply(df, k__in=given)) == sorted(inside, key=repr)
        assert rows(fl.apply(df, k__not_in=given)) == sorted(out, key=repr)
        assert rows(fl.apply(df, {"$or": [{"k__in": given}, {"k__in": []}]})) == sorted(inside, key=repr)
        assert rows(fl.apply(df, {"$not": {"k__in": given}})) == sorted(out, key=repr)


@pytest.mark.parametrize(
    "kind, column, own, values, inside",
    [
        ("string", ["007", "7", "8"], "int", [7, 8], ["7", "8"]),
        ("int", [7, 8, 9], "string", ["7", "8.0", "9.5", "x"], [7, 8]),
        ("int", [7, 8, 9], "double", [7.0, 8.5, 9.0], [7, 9]),
        ("long", [7, 8], "int", [7], [7]),
        ("double", [0.5, 2.0], "string", ["0.50", "2"], [0.5, 2.0]),
        ("decimal(10,2)", [N("1.50"), N("2.00")], "decimal(12,4)", [N("1.5000"), N("2.0001")], [N("1.50")]),
        ("boolean", [True, False], "int", [0, 5], [False]),
        ("date", [D(2024, 1, 2), D(2024, 1, 3)], "timestamp_ntz", [T(2024, 1, 2, 10), T(2024, 1, 3)], [D(2024, 1, 3)]),
        ("timestamp_ntz", [T(2024, 1, 2), T(2024, 1, 2, 1)], "date", [D(2024, 1, 2)], [T(2024, 1, 2)]),
    ],
)
def test_frames_follow_the_rules_of_lists(spark, kind, column, own, values, inside):
    df = spark.createDataFrame([(v,) for v in [*column, None]], f"k {kind}")
    given = spark.createDataFrame([(v,) for v in [*values, None]], f"v {own}")
    out = [v for v in column if v not in inside]
    assert rows(fl.apply(df, k__in=given)) == sorted(inside, key=repr) and rows(fl.apply(df, k__not_in=given)) == sorted(out, key=repr)
    assert rows(fl.apply(df, {"$or": [{"k__not_in": given}, {"k": "none"} if kind == "string" else {"k__in": []}]})) == sorted(out, key=repr)


def test_nothing_is_in_an_empty_list_or_frame(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    none = spark.createDataFrame([(None,)], "v int").where("v > 0")
    for empty in ([], none):
        assert rows(fl.apply(df, k__not_in=empty)) == rows(df) and rows(fl.apply(df, k__in=empty)) == []
        assert rows(fl.apply(df, {"$or": [{"k__not_in": empty}, {"k": 1}]})) == rows(df)
        assert rows(fl.apply(df, k__in=empty, exclude=True)) == rows(df)


def test_comparisons_of_texts_are_by_text(spark):
    df = spark.createDataFrame([("7",), ("007",), ("x",)], "k string")
    assert rows(fl.apply(df, k=7)) == ["7"] and rows(fl.apply(df, k__ne=7)) == ["007", "x"]
    with pytest.raises(fl.FilterError):
        fl.apply(df.select(F.lit(1).alias("n")), n__in=["seven"])


def test_guard_of_statements():
    assert guard.check("/* a */ select 'it''s; --' as x -- end") == "select 'it''s; --' as x"
    assert guard.check('with t as (select 1 as "drop;") select * from t ; ') == 'with t as (select 1 as "drop;") select * from t'
    for bad in ("select 'a\\'; drop table t; --'", "select 1; select 2", "-- x", "explain select 1", "select * from t where delete", "/* x */ insert into t select 1"):
        with pytest.raises(guard.UnsafeSqlError):
            guard.check(bad)
