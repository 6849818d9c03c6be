"""Small invented logs, and the miners' numbers on them straight from their definitions."""

from collections import Counter


def split(text):
    return [line.split() for line in text.strip().split("/")]


LOGS = {
    # a parcel's way, with returns and cancellations
    "parcel": split(
        "book pack send sign / book pack send back pack send sign / book cancel / "
        "book pack cancel / pack book send sign / book pack send send sign"
    ),
    # variants of a shift with how often they occur
    "shift": [
        t.split()
        for t, n in [
            ("in plan cut weld out", 9), ("in plan weld cut out", 8), ("in test out", 7),
            ("in out", 4), ("in test test out", 3), ("plan out", 2), ("in cut test out", 1),
        ]
        for _ in range(n)
    ],
    # steps that repeat and go back
    "loops": split("p q q r / p r q p r / q q q q / r p q r p q r / p"),
    # two parts that never meet, one of them with a fork and a join
    "apart": split("u v x / u w x / u v x / m n / n m / m m n / u v w x"),
    "single": split("only only / only"),
}


def steps_of(traces):
    return Counter(pair for t in traces for pair in zip(t, t[1:]))


def log_of(spark, traces, **options):
    from tracemill import EventLog

    rows = [(i, t) for i, t in enumerate(traces)]
    df = spark.createDataFrame(rows, "id long, trace array<string>")
    return EventLog.from_traces(df, case="id", **options)


def model_of(spark, traces, **options):
    from tracemill import base_model

    return base_model(log_of(spark, traces, **options))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
