"""Files of messages as a data source: filters, files, commits, streams."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.field import Field, FieldMeta
from isobar.sources import catalog, gridmsg, slabs

from .test_fields import field


def table(spark, name="T", members=(0, 1)):
    own = field(spark, name)
    out = slabs.to_slabs(own)
    return out.withColumn("eps", F.explode(F.array(*map(F.lit, members)))).withColumns({"ref_time": F.lit("2024-01-01T06:00:00Z").cast("timestamp"), "lead_s": (F.col("eps") * 3600).cast("long")})


def rows(df):
    return sorted(json.dumps([str(v) for v in r]) for r in df.select(sorted(df.columns)).collect())


def files(path):
    return sorted(p for p in Path(path).rglob("*") if p.is_file())


def test_message_round_trip():
    n, present = np.arange(7), np.arange(7) % 3 > 0
    raw = gridmsg.pack({"param": "T", "places": ["cell"]}, [np.arange(7) * 5], n, present)
    keys, (cells,), got, there = gridmsg.unpack(raw)
    assert keys["param"] == "T" and cells.tolist() == list(range(0, 35, 5)) and got.tolist() == n.tolist() and there.tolist() == present.tolist()
    for bad in (raw[:-1], b"x" + raw[1:], raw + b"7777"):
        with pytest.raises(ValueError):
            gridmsg.unpack(bad)


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "m")
    gaps = field(spark, "G")
    gaps = slabs.to_slabs(gaps.derive(gaps.df.withColumn("value", F.when(F.col("x") != 3, F.col("value")))))
    both = table(spark).unionByName(gaps)
    gridmsg.write(both, path)
    assert rows(gridmsg.read(spark, path)) == rows(both) and files(path) and not list(Path(path).glob("_temporary*"))
    gridmsg.write(table(spark, "C"), path)  # appended
    assert gridmsg.read(spark, path).select("param").distinct().count() == 3
    gridmsg.write(table(spark, "D"), path, mode="overwrite")
    assert rows(gridmsg.read(spark, path)) == rows(table(spark, "D"))
    cells = slabs.to_slabs(Field(spark.createDataFrame([(0, 1.0), (10**10, None)], "cell long, value double"), FieldMeta("T")))
    gridmsg.write(cells, str(tmp_path / "c"))
    assert rows(gridmsg.read(spark, str(tmp_path / "c"), "cell")) == rows(cells)
    with pytest.raises(Exception, match="places are cell"):
        gridmsg.read(spark, str(tmp_path / "c")).collect()
    with pytest.raises(Exception, match="nowhere"):
        gridmsg.read(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "none").mkdir()
    assert gridmsg.read(spark, str(tmp_path / "none")).count() == 0
    assert slabs.load_single(slabs.DataSource(gridmsg.read(spark, path)), {"param": "D", "number": 1, "levelist": [2]}).df.count() == 30


def spoil(path, keep):
    """Overwrite the messages that ``keep`` does not want: reading one of them is an error."""
    left = 0
    for p in files(path):
        raw = bytearray(p.read_bytes())
        with gridmsg.arrow_fs.LocalFileSystem().open_input_file(str(p)) as f:
            index = gridmsg.read_index(f)
        for m in index:
            if keep(m):
                left += 1
            else:
                raw[m["at"]: m["at"] + m["length"]] = bytes(m["length"])
        p.write_bytes(raw)
    return left


@pytest.mark.parametrize("split", [1500, 1 << 20])
def test_only_matching_messages_are_read(spark, tmp_path, split):
    path = str(tmp_path / "m")
    gridmsg.write(table(spark, members=(0, 1, 2)).unionByName(table(spark, "U")).coalesce(2), path)
    assert spoil(path, lambda m: m["param"] == "T" and m["eps"] in (1, 2) and m["k"] == 2) == 2
    source = slabs.DataSource(gridmsg.read(spark, path, split=split))
    got = source.retrieve(catalog.Request("T", number=[1, 2], levelist=2, ref_time="2024-01-01T06:00:00/.."))
    assert sorted((r.param, r.eps, r.k) for r in got.select("param", "eps", "k").collect()) == [("T", 1, 2), ("T", 2, 2)]
    late = gridmsg.read(spark, path, split=split).where("param = 'T' and k = 2 and lead_s >= 3600 and ref_time = timestamp'2024-01-01 06:00:00'")
    assert late.count() == 2
    with pytest.raises(Exception, match="no message"):
        gridmsg.read(spark, path, split=split).collect()


def test_a_box_reads_the_tiles_that_it_touches(spark, tmp_path):
    """Points in a box from messages and from Parquet, and nothing read of tiles elsewhere."""
    whole, path = field(spark), str(tmp_path / "m")
    table = slabs.to_slabs(whole, bits=32, tile=(2, 3))
    points = lambda t: rows(slabs.from_slabs(t).withColumn("value", F.round("value", 6)))
    assert table.count() == 2 * 2 * 3 and points(table) == points(slabs.to_slabs(whole, bits=32))
    gridmsg.write(table.coalesce(2), path)
    own = slabs.located(whole).df.where("x = 4 and y = 0 and k = 1").first()
    box = (own.lon - 0.01, own.lat - 0.01, own.lon + 0.01, own.lat + 0.01)
    touched = [(r.k, r.tile) for r in slabs.DataSource(table).retrieve(catalog.Request("T", box=box)).select("k", "tile").collect()]
    assert sorted(touched) == [(1, 1), (2, 1)] and spoil(path, lambda m: m["tile"] == 1) == 2
    got = slabs.load_single(slabs.DataSource(gridmsg.read(spark, path)), {"param": "T", "box": box}).df
    assert [(r.k, r.y, r.x) for r in got.orderBy("k").collect()] == [(1, 0, 4), (2, 0, 4)]
    slabs.save([whole], str(tmp_path / "p"), bits=32, tile=(2, 3))
    again = slabs.load_single(slabs.DataSource.of_files(spark, [str(tmp_path / "p")]), {"param": "T", "box": box}).df
    assert rows(again.select("k", "y", "x")) == rows(got.select("k", "y", "x"))
    wide = slabs.load_single(slabs.DataSource(table), {"param": "T", "box": (own.lon - 0.01, -90, own.lon - 0.02, 90)}).df  # over the date line, all but a strip
    assert wide.count() == 60
    with pytest.raises(ValueError):
        catalog.Request("T", box=(0, 5, 1, 4))


def test_files_by_name_and_failed_jobs(spark, tmp_path):
    path = str(tmp_path / "m")
    named = table(spark).withColumn("file", F.concat(F.lit("run/m"), F.col("eps"), F.lit(".gmsg")))
    gridmsg.write(named, path, "file")
    assert [str(p.relative_to(path)) for p in files(path)] == ["run/m0.gmsg", "run/m1.gmsg"]
    assert rows(gridmsg.read(spark, f"{path}/run/m1.gmsg")) == rows(table(spark).where("eps = 1"))
    before = [p.read_bytes() for p in files(path)]
    broken = named.withColumn("lead_s", F.when(F.col("eps") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("lead_s")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        gridmsg.write(broken, path, "file")
    assert [p.read_bytes() for p in files(path)] == before  # nothing of it is left


def test_repeated_tasks_leave_one_copy(spark, tmp_path):
    """Two attempts of one task write; the message of one is committed."""
    os.makedirs(tmp_path / "m")
    own = table(spark).withColumn("file", F.lit("a.gmsg"))
    writer = gridmsg.MessageWriter({"path": str(tmp_path / "m")}, own.schema, False)
    _, second = writer.write(iter(own.collect())), writer.write(iter(own.collect()))
    writer.commit([second])
    assert [p.name for p in files(tmp_path / "m")] == ["a.gmsg"] and rows(gridmsg.read(spark, str(tmp_path / "m"))) == rows(table(spark))
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([writer.write(iter(own.collect())), writer.write(iter(own.collect()))])


def test_stream_reads_each_file_once(spark, tmp_path):
    path, log, out, check = (str(tmp_path / n) for n in ("in", "log", "out", "check"))

    def run():
        q = (gridmsg.stream(spark, path, log, files_per_batch=1).select("param", "eps", "k").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", check).trigger(availableNow=True).start())
        q.awaitTermination()

    gridmsg.write(table(spark).coalesce(1), path)
    run()
    assert spark.read.parquet(out).count() == 4
    run()  # nothing new
    gridmsg.write(table(spark, "U").coalesce(1), path)
    gridmsg.write(table(spark, "V").coalesce(1), path)
    run()
    run()
    assert sorted((r.param, r["count"]) for r in spark.read.parquet(out).groupBy("param").count().collect()) == [("T", 4), ("U", 4), ("V", 4)]


def test_offsets_are_the_same_after_a_restart(spark, tmp_path):
    gridmsg.write(table(spark).coalesce(1), str(tmp_path / "in"))
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}
    make = lambda: gridmsg.MessageStream(options, None)
    assert make().latestOffset() == {"entries": 1} == make().latestOffset()
    first = make().partitions({"entries": 0}, {"entries": 1})
    gridmsg.write(table(spark, "U").coalesce(1), str(tmp_path / "in"))
    assert make().latestOffset() == {"entries": 2}
    assert make().partitions({"entries": 0}, {"entries": 1}) == first and len(make().partitions({"entries": 1}, {"entries": 2})) == 1
    with pytest.raises(ValueError):
        gridmsg.MessageStream({"path": "x"}, None)
