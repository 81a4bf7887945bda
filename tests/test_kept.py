"""What is written and read again: reports, rejected lines and totals; and idle buckets."""

import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.fixtures import SMALL_CAPTURE, capture, rows
from wiretally import sinks
from wiretally.operators import rates, totals
from wiretally.plans.report import build_report
from wiretally.schema import GEO_SCHEMA
from wiretally.sources.packets import (
    count_capture_rejects,
    count_rejected,
    read_captures,
    split_captures,
)


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([], GEO_SCHEMA)


def run_ids(spark, path, name):
    return sorted(r["run_id"] for r in sinks.read_report(spark, path, name).select("run_id").distinct().collect())


def test_a_lost_or_repeated_run_leaves_whole_runs_only(spark, blocks, tmp_path, monkeypatch):
    path, packets = str(tmp_path / "reports"), capture(spark, SMALL_CAPTURE)
    sinks.write_report(build_report(packets, blocks, "first"), path)
    again = build_report(packets, blocks, "second")
    write, calls = sinks.write_document, []

    def lost(df, *args, **kwargs):
        calls.append(args)
        if len(calls) == 3:
            raise OSError("the driver went away")
        write(df, *args, **kwargs)

    monkeypatch.setattr(sinks, "write_document", lost)
    with pytest.raises(OSError):
        sinks.write_report(again, path)
    # Two tables of the lost run were written, and none of their rows is seen.
    assert len(calls) == 3 and spark.read.json(f"{path}/series").where("run_id = 'second'").count() == 3
    for name in again._fields:
        assert run_ids(spark, path, name) == ["first"]
    monkeypatch.setattr(sinks, "write_document", write)
    whole = {name: sinks.read_report(spark, path, name).count() for name in again._fields}
    sinks.write_report(again, path)
    sinks.write_report(build_report(packets, blocks, "second"), path)
    for name in again._fields:
        assert run_ids(spark, path, name) == ["first", "second"]
        assert sinks.read_report(spark, path, name).count() == 2 * whole[name] > 0
    header = sinks.read_report(spark, path, "header")
    assert sinks.ATTEMPT not in header.columns


def test_rejected_lines_come_from_the_pass_that_types_the_others(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SMALL_CAPTURE + "x,y,abc,TCP,6,1\n")
    (tmp_path / "n.csv").write_text("10.0.0.5,10.0.0.6,10,TCP,6,50\n,,1,TCP,6,noon\n")
    paths = {"attack": str(tmp_path / "a.csv"), "normal": str(tmp_path / "n.csv")}
    packets, rejects = split_captures(spark, paths, str(tmp_path / "split"))
    assert sorted(map(repr, packets.collect())) == sorted(map(repr, read_captures(spark, paths).collect()))
    assert rows(count_rejected(rejects)) == rows(count_capture_rejects(spark, paths))
    assert rows(rejects.select("capture", F.element_at(F.split("file", "/"), -1), "reason", "line")) == [
        ("attack", "a.csv", "arity", "10.0.0.1,10.0.0.9,60,ICMP,1"),
        ("attack", "a.csv", "arity", "10.0.0.3,10.0.0.9,10.0.0.9,60,ICMP,1,1,103.5"),
        ("attack", "a.csv", "data_length", "x,y,abc,TCP,6,1"),
        ("normal", "n.csv", "arrival_time", ",,1,TCP,6,noon"),
    ]
    # Neither reads the text again.
    for df in (packets, rejects):
        assert "Format: Text" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_without_a_sort(spark, tmp_path, monkeypatch):
    """A sort would hold a task's lines, text and file name included, in memory."""
    (tmp_path / "a.csv").write_text(SMALL_CAPTURE)
    (tmp_path / "n.csv").write_text("10.0.0.5,10.0.0.6,10,TCP,6,50\n,,1,TCP,6,noon\n")
    paths = {"attack": str(tmp_path / "a.csv"), "normal": str(tmp_path / "n.csv")}
    folders, written = [], DataFrameWriter.parquet

    def parquet(writer, path, **kwargs):
        folders.append(path)
        written(writer, path, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    folder = tmp_path / "split"
    packets, rejects = split_captures(spark, paths, str(folder))
    # One job, and no folder of a column's value, for which Spark sorts.
    assert folders == [str(folder)] and not any(x.is_dir() for x in folder.iterdir())
    assert (packets.count(), rejects.count()) == (7, 3)
    # A file has one capture, so that its statistics leave it out for the other.
    by_file = spark.read.parquet(str(folder)).groupBy("_metadata.file_path").agg(F.count_distinct("capture").alias("n"))
    assert {r["n"] for r in by_file.collect()} == {1}
    # Written again, nothing of the first time stays.
    packets, rejects = split_captures(spark, {"normal": paths["normal"]}, str(folder))
    assert (packets.count(), rejects.count()) == (1, 1)


@pytest.mark.parametrize("width", [1, 2, 7])
def test_idle_buckets(spark, width):
    # 131,072 seconds between two packets, and a capture of one second.
    text = "a,b,5,TCP,6,100\na,b,7,TCP,6,100.5\na,b,9,ICMP,1,131200\n"
    packets = capture(spark, text).union(capture(spark, "a,b,3,TCP,6,-5\n", "normal"))
    series = rates.with_idle(rates.traffic_per_bucket(packets, width), width)
    assert series.dtypes == rates.traffic_per_bucket(packets, width).dtypes
    first, last = 100 // width * width, 131200 // width * width
    attack = {r["second"]: r for r in series.where("capture = 'attack'").collect()}
    assert sorted(attack) == list(range(first, last + 1, width))
    assert [(s, r["packets"], r["bytes"], r["ICMP"]) for s, r in sorted(attack.items()) if r["packets"]] == [
        (first, 2, 12, 0), (last, 1, 9, 1),
    ]
    assert series.where("capture = 'normal'").count() == 1
    indexed = rates.packets_per_second(packets, width, idle=True)
    assert indexed.where("capture = 'attack' and idx <> (second - {}) / {}".format(first, width)).count() == 0
    n = len(attack)
    assert rows(rates.rate_summary(packets, "bytes", width, idle=True)) == [
        ("attack", pytest.approx(21 / n), 0, 12), ("normal", 3.0, 3, 3),
    ]
    plan = rates.with_idle(rates.traffic_per_bucket(packets, width), width)._jdf.queryExecution().executedPlan()
    assert not any(word in plan.toString() for word in ("NestedLoop", "Cartesian", "Python"))


def test_adding_a_file_equals_a_full_rebuild(spark, tmp_path):
    day = 86_400
    one = capture(spark, SMALL_CAPTURE)
    late = capture(spark, f"10.0.0.1,10.0.0.9,60,ICMP,1,{day + 5}\n10.0.0.7,10.0.0.9,1,TCP,6,101.25\n")
    wrong = capture(spark, "x,y,1,TCP,6,101\n")
    folder, rebuilt = str(tmp_path / "kept"), str(tmp_path / "rebuilt")
    totals.add_source(one, folder, "one")
    before = sorted((tmp_path / "kept" / "pairs" / "source=one").rglob("*.parquet"))
    totals.add_source(wrong, folder, "late")
    totals.add_source(late, folder, "late")
    assert sorted((tmp_path / "kept" / "pairs" / "source=one").rglob("*.parquet")) == before
    every = one.union(late)
    totals.add_source(every, rebuilt, "all")
    for table in (totals.pair_totals, totals.host_totals, totals.traffic_totals):
        assert rows(table(spark, folder)) == rows(table(spark, rebuilt))
    assert rows(totals.traffic_totals(spark, folder)) == rows(rates.traffic_per_bucket(every).select(totals.traffic_totals(spark, folder).columns))
    first_day = (datetime.date(1970, 1, 1),) * 2
    assert totals.pair_totals(spark, folder, first_day).agg(F.sum("n")).head()[0] == 7
    plan = totals.pair_totals(spark, folder, first_day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
