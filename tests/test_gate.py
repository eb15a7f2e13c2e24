"""The gate for complete runs as a stateful stream."""

from datetime import datetime, timedelta

import pytest

from isobar.streaming import runs

LEADS = list(range(121))


class Arrivals:
    """Files of arrivals, a batch for each, and the gate's rows after it."""

    def __init__(self, spark, tmp_path, required, late="2 days"):
        self.spark, self.required, self.late = spark, required, late
        self.landing, self.out, self.check = (str(tmp_path / n) for n in ("in", "out", "check"))
        self.schema = "ref_time timestamp, lead_h int"
        spark.createDataFrame([], self.schema).write.parquet(self.landing)

    def __call__(self, rows):
        self.spark.createDataFrame([(at, lead) for at, lead in rows], self.schema).coalesce(1).write.mode("append").parquet(self.landing)
        stream = self.spark.readStream.schema(self.schema).parquet(self.landing)
        q = (runs.run_states(stream, self.required, self.late).writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.check)
             .trigger(availableNow=True).start())  # a new query each time: it starts again from the checkpoint
        q.awaitTermination()
        return sorted((r.ref_time.day, r.status, r.have) for r in self.spark.read.schema(runs.OUT).parquet(self.out).collect())


def day(n):
    return datetime(2024, 1, n)


def test_many_lead_times_once_each(spark, tmp_path):
    arrive = Arrivals(spark, tmp_path, LEADS)
    assert arrive([(day(1), h) for h in LEADS[:100]] + [(day(2), h) for h in LEADS]) == [(2, "complete", 121)]
    assert arrive([(day(1), h) for h in LEADS[50:]] * 2 + [(day(2), 7), (day(1), 500), (day(1), None), (None, 1)]) == [(1, "complete", 121), (2, "complete", 121)]
    assert arrive([(day(1), h) for h in LEADS] + [(day(2), h) for h in LEADS]) == [(1, "complete", 121), (2, "complete", 121)]  # all of it again


def test_late_runs_expire(spark, tmp_path):
    arrive = Arrivals(spark, tmp_path, [0, 6, 12])
    arrive([(day(1), 0), (day(1), 6), (day(3), 0)])
    arrive([(day(4) + timedelta(hours=1), 0)])  # the first run is more than two days behind
    found = arrive([(day(1), 12), (day(3), 6), (day(3), 12)])  # too late for one, in time for the other
    assert found == [(1, "expired", 2), (3, "complete", 3)]
    arrive([(day(9), 0)])
    assert arrive([(day(9), 6)]) == found + [(4, "expired", 1)]


def test_nothing_is_required(spark):
    with pytest.raises(ValueError):
        runs.run_states(spark.createDataFrame([], "ref_time timestamp, lead_h int"), [])
