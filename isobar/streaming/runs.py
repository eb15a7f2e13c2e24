"""Streams of slabs and the gate that lets complete runs through."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from isobar.sources.catalog import Request

#: The state store whose states have timers and maps. Fixed value.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "ref_time timestamp, status string, have long, need long"


def read_slabs(spark: SparkSession, folder: str, schema: StructType, request: Request | None = None, files_per_batch: int = 100) -> DataFrame:
    """Slabs as they land in ``folder``, a bounded number of files at a time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return (request or Request()).read(stream)


class RunGate(StatefulProcessor):
    """State of one run: the lead times that have come, how many, and whether the run was let through.

    A lead time is an entry of a map in the store, so there may be any number of them and an arrival
    costs one look-up. The map goes when the run is complete; the mark that it was let through goes,
    with what else is left, when the watermark passes the run's reference time.
    """

    def __init__(self, required: Iterable[int]):
        self.required = frozenset(required)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "lead_h int", "there boolean")
        self.state = handle.getValueState("state", "have long, through boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (at,) = key
        first = not self.state.exists()
        have, through = (0, False) if first else self.state.get()
        if through:
            return
        if first:
            self.handle.registerTimer(int(at.timestamp() * 1000))
        for row in rows:
            lead = row["lead_h"]
            if lead in self.required and not self.seen.containsKey((lead,)):
                self.seen.updateValue((lead,), (True,))
                have += 1
        if have == len(self.required):
            self.seen.clear()
            through = True
            yield Row(ref_time=at, status="complete", have=have, need=have)
        self.state.update((have, through))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        have, through = self.state.get() if self.state.exists() else (0, True)
        self.seen.clear()
        self.state.clear()
        if not through:
            yield Row(ref_time=key[0], status="expired", have=have, need=len(self.required))

    def close(self) -> None:
        pass


def run_states(assets: DataFrame, required: Sequence[int], late: str = "2 days") -> DataFrame:
    """``ref_time, status, have, need`` of the runs of a stream ``assets(ref_time, lead_h)``: once
    ``complete`` when the last of the required lead times arrives, or once ``expired`` when runs that
    are newer by ``late`` have come before that. Write it in append mode.

    Repeated arrivals and other lead times change nothing, null times are left out, and so is what
    comes after a run's expiry. ValueError if no lead time is required. The session's streams need the
    store :data:`STORE`, which is set here.
    """
    if not set(required):
        raise ValueError("no lead time is required")
    spark = assets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = assets.where("ref_time is not null and lead_h is not null").select("ref_time", F.col("lead_h").cast("int").alias("lead_h"))
    return rows.withWatermark("ref_time", late).groupBy("ref_time").transformWithState(RunGate(required), OUT, "append", "eventTime")


def complete_runs(assets: DataFrame, required: Sequence[int], late: str = "2 days") -> DataFrame:
    """``ref_time`` of the runs that are complete, each once (see :func:`run_states`)."""
    return run_states(assets, required, late).where("status = 'complete'").select("ref_time")
