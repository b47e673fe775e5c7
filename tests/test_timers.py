"""Debounce by timers: out of order, late and across a restart."""

import pandas as pd

from srcweave.streaming.timers import OUT, PROVIDER, _Runs, debounce_timers, late_events

SHAPE = "path string, type string, ts timestamp, seq long"


def _run(spark, base, batches, gap=0.5):
    late = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for rows in batches:  # each batch is a run of its own, started again from the checkpoint
            spark.createDataFrame(rows, "path string, type string, at string, seq long").selectExpr("path", "type", "cast(at as timestamp) as ts", "seq").coalesce(1).write.mode("append").parquet(f"{base}/events")
            out = debounce_timers(spark.readStream.schema(SHAPE).parquet(f"{base}/events"), gap, "2 seconds").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check")
            query = out.outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            late.append(late_events(query))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.schema(OUT).parquet(f"{base}/out").selectExpr("path", "type", "date_format(ts, 'ss.SSSSSS') as at", "merged").where("path <> '~'")
    return sorted(map(tuple, rows.collect())), late


def test_runs_to_the_microsecond_late_events_and_restarts(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s}"
    got = _run(spark, str(tmp_path), [
        [("a", "change", at("01.499999"), 2), ("a", "add", at("01.000000"), 1), ("b", "add", at("01.000000"), 1), ("b", "unlink", at("01.500000"), 2)],
        [("a", "unlink", at("01.900000"), 3), ("c", "add", at("03.000000"), 1)],
        [("c", "change", at("03.000000"), 2), ("~", "end", at("30.000000"), 0)],
        [("a", "add", at("01.950000"), 4), ("c", "add", at("31.000000"), 3), ("~", "end", at("59.000000"), 1)],
    ])
    assert got == (
        [("a", "unlink", "01.900000", 3), ("b", "add", "01.000000", 1), ("b", "unlink", "01.500000", 1), ("c", "add", "31.000000", 1), ("c", "change", "03.000000", 2)],
        [0, 0, 0, 1],
    )


class _State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def clear(self):
        self.rows = []


class _Value(_State):
    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.rows = [row]


class _Handle:
    def __init__(self):
        self.timers, self.registered = set(), 0

    def getListState(self, *_):  # noqa: N802
        return _State()

    def getValueState(self, *_):  # noqa: N802
        return _Value()

    def registerTimer(self, millis):  # noqa: N802
        self.timers.add(millis)
        self.registered += 1

    def deleteTimer(self, millis):  # noqa: N802
        self.timers.remove(millis)


def test_a_path_has_one_timer_whatever_its_events():
    handle, runs = _Handle(), _Runs(10_000_000)
    runs.init(handle)
    batch = pd.DataFrame({"micros": [k * 1_000_000 for k in range(999, -1, -1)], "seq": range(1000), "type": "add"})
    assert list(runs.handleInputRows(("a",), iter([batch]), None)) == [] and len(handle.timers) == 1 and handle.registered == 1
    out, calls = [], 0
    for passed in (500_000, 500_500, 2_000_000):
        while due := [t for t in handle.timers if t <= passed]:
            clock = type("T", (), {"getCurrentWatermarkInMs": lambda self, p=passed: p})()
            out += [tuple(r) for df in runs.handleExpiredTimer(("a",), clock, None) for r in df[["path", "type", "merged"]].itertuples(index=False)]
            handle.timers -= set(due)
            calls += 1
    assert out == [("a", "add", 1000)] and calls <= 4 and not handle.timers
