import random

import pytest

from fixtures import rows
from tracemill import frequency_bands
from tracemill.operators.bands import band_cuts

SHAPES = {
    "even": lambda r: list(range(100)),
    "skewed": lambda r: [int(r.paretovariate(0.7)) for _ in range(300)],
    "few": lambda r: [r.choice([3, 5, 9]) for _ in range(40)],
    "eight": lambda r: [2**k for k in range(8)] * 3,
    "nine": lambda r: [2**k for k in range(9)],
    "one": lambda r: [7] * 5,
    "shares": lambda r: [r.random() for _ in range(200)],
    "wide": lambda r: [-5e-7, 1e-5, 1e17, 3e16, -2e16, 0, 1, 2, 3, 4, 5, 6e15],
    "mirror": lambda r: [0, 1, 2, 3, 50, 51, 52, 53, 54, 100, 101, 102, 103],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_bands(spark, shape):
    values = [float(v) for v in SHAPES[shape](random.Random(3))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows(frequency_bands(df, "v"), "v", "band")
    assert len(got) == len(values)
    bands = [b for _, b in got]
    assert bands == sorted(bands) and bands[0] == 0.0
    by_value = {}
    for v, b in got:
        assert by_value.setdefault(v, b) == b
    assert sorted(set(bands)) == [float(k) for k in range(min(8, len(set(values))))]


@pytest.mark.parametrize("shape", SHAPES)
def test_runs_of_many_values_give_the_same_cuts(spark, shape):
    """Runs that a boundary cuts are read; the rest are known by their moments."""
    values = [float(v) for v in SHAPES[shape](random.Random(5))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert band_cuts(df, "v", runs=9) == band_cuts(df, "v")


def test_rounds_read_nothing_where_a_run_is_a_value(spark, monkeypatch):
    from tracemill.operators import bands

    def no_reading(*_):
        raise AssertionError("read")

    df = spark.range(3000).selectExpr("cast(id * id as double) v")
    cuts = band_cuts(df, "v", runs=50)
    monkeypatch.setattr(bands._Histogram, "_read", no_reading)
    assert band_cuts(df, "v") == cuts
    with pytest.raises(AssertionError, match="read"):
        band_cuts(df, "v", runs=50)


def test_even_values_fill_bands_evenly(spark):
    df = spark.range(800).selectExpr("cast(id as double) v")
    sizes = [n for _, n in rows(frequency_bands(df, "v").groupBy("band").count(), "band", "count")]
    assert max(sizes) <= 2 * min(sizes)


def test_empty(spark):
    df = spark.createDataFrame([], "v double")
    assert frequency_bands(df, "v").count() == 0
