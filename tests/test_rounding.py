import random

import numpy as np
from pyspark.sql import functions as F

from fixtures import rows
from tracemill.functions import fmt2, mean2, np2


def test_two_decimals_match_python(spark):
    r = random.Random(1)
    values = [m / 200 for m in range(0, 201)] + [r.random() for _ in range(3000)]
    values += [a / b for b in range(1, 60) for a in range(0, b + 1)]
    values += [np.nextafter(m / 200, d) for m in range(1, 200, 2) for d in (0, 1)]
    values = sorted({float(v) for v in values})
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", fmt2(F.col("x")).alias("f"), np2(F.col("x")).alias("n")).collect()
    assert [(x, f) for x, f, _ in got if f != float(format(x, ".2f"))] == []
    assert [(x, n) for x, _, n in got if n != float(np.round(x, 2))] == []


def test_means_of_hundredths(spark):
    r = random.Random(2)
    data = [(g, i, r.randint(1, 100) / 100) for g in range(400) for i in range(r.randint(1, 6))]
    df = spark.createDataFrame(data, "g long, i long, v double").repartition(7)
    want_np, want_fmt = [], []
    for g in range(400):
        values = [v for k, _, v in data if k == g]
        mean = sum(round(v * 100) for v in values) / 100 / len(values)
        want_np.append((g, len(values), float(np.round(mean, 2))))
        want_fmt.append((g, len(values), float(format(mean, ".2f"))))
    assert rows(mean2(df, ["g"], "v", np2, "m"), "g", "size", "m") == want_np
    assert rows(mean2(df, ["g"], "v", fmt2, "m"), "g", "size", "m") == want_fmt


def test_means_do_not_depend_on_the_size_of_a_group(spark):
    pairs = [(0.01, 0.02), (0.29, 0.28), (0.15, 0.14), (0.35, 0.36), (0.5, 0.25)]
    small = [(i, v) for i, p in enumerate(pairs) for v in p]
    df = spark.createDataFrame(small, "g long, v double")
    large = df.crossJoin(spark.range(20_000)).select("g", "v")
    for rounding in (np2, fmt2):
        assert rows(mean2(df, ["g"], "v", rounding, "m"), "g", "m") == rows(
            mean2(large, ["g"], "v", rounding, "m"), "g", "m")
