"""Streams of capture files against the same files read as one table."""

import os

import pytest

from tests.fixtures import rows
from wiretally.operators import pairs, rates, totals
from wiretally.sources.packets import read_captures
from wiretally.streaming import traffic

# Files in order of arrival; the third holds a packet far behind the second's.
FILES = (
    ("attack", ["1.1.1.1,2.2.2.2,60,TCP,6,100.5", "1.1.1.1,2.2.2.2,40,UDP,17,101.0", "short,line"]),
    ("attack", ["1.1.1.2,2.2.2.2,70,ICMP,1,200.1", "1.1.1.1,2.2.2.2,10,DNS,17,200.9"]),
    ("attack", ["1.1.1.1,2.2.2.2,5,TCP,6,101.7", "1.1.1.1,2.2.2.3,6,TCP,6,205.0"]),
    ("normal", ["1.1.1.1,2.2.2.2,9,HTTP,6,205.5"]),
)


@pytest.fixture
def place(tmp_path):
    """Folders of the two captures, and a function that puts the next files there."""
    folders = {c: str(tmp_path / c) for c in ("attack", "normal")}
    for folder in folders.values():
        os.mkdir(folder)
    waiting = list(enumerate(FILES))

    def arrive(n):
        for i, (capture, lines) in [waiting.pop(0) for _ in range(n)]:
            path = f"{folders[capture]}/{i}.csv"
            with open(path, "w") as out:
                out.write("\n".join(lines) + "\n")
            os.utime(path, (1_000_000 + i, 1_000_000 + i))

    return folders, arrive


def _drained(query):
    query.awaitTermination()
    assert query.exception() is None


def test_totals_of_a_stream_equal_those_of_its_files(spark, place, tmp_path):
    folders, arrive = place
    kept, checkpoint = str(tmp_path / "kept"), str(tmp_path / "checkpoint")

    def follow():
        _drained(traffic.keep_totals(traffic.stream_captures(spark, folders, files=1), kept, checkpoint))
        packets = read_captures(spark, folders)
        assert rows(totals.traffic_totals(spark, kept)) == rows(rates.traffic_per_bucket(packets))
        pair_rows = totals.pair_totals(spark, kept).drop("bytes")
        assert rows(pair_rows) == rows(pairs.pair_counts(packets).select(*pair_rows.columns))

    # Nothing there yet, files in order, a late packet after a restart, nothing new.
    for n in (0, 2, 2, 0):
        arrive(n)
        follow()


def test_a_batch_lost_half_way_is_not_counted_twice(spark, place, tmp_path, monkeypatch):
    folders, arrive = place
    kept, checkpoint = str(tmp_path / "kept"), str(tmp_path / "checkpoint")
    packets = traffic.stream_captures(spark, folders, files=1)
    arrive(4)
    add_source = traffic.add_source

    def lost(batch, folder, source):
        add_source(batch, folder, source)
        if source == "stream-1":
            raise RuntimeError("lost")

    monkeypatch.setattr(traffic, "add_source", lost)
    with pytest.raises(Exception, match="lost"):
        traffic.keep_totals(packets, kept, checkpoint).awaitTermination()
    monkeypatch.setattr(traffic, "add_source", add_source)
    _drained(traffic.keep_totals(packets, kept, checkpoint))
    want = rates.traffic_per_bucket(read_captures(spark, folders))
    assert rows(totals.traffic_totals(spark, kept)) == rows(want)


def test_closed_buckets_and_what_came_late(spark, place, tmp_path):
    folders, arrive = place
    closed, checkpoint = str(tmp_path / "closed"), str(tmp_path / "checkpoint")
    schema = rates.traffic_per_bucket(read_captures(spark, folders)).schema

    def follow():
        # One batch a run, so that each one knows the watermark of those before it.
        stream = traffic.stream_captures(spark, folders)
        _drained(traffic.write_closed(traffic.closed_buckets(stream, lateness="10 seconds"), closed, checkpoint))
        return spark.read.schema(schema).parquet(closed)

    arrive(1)
    assert rows(follow()) == []
    arrive(1)
    first = [("attack", 100, 1, 60, 0, 1, 0, 0, 0), ("attack", 101, 1, 40, 0, 0, 0, 1, 0)]
    assert rows(follow()) == first
    arrive(2)
    # Seconds that are over are not written again.
    assert rows(follow()) == first
    late = traffic.corrections(rates.traffic_per_bucket(read_captures(spark, folders)), follow())
    assert rows(late) == [
        ("attack", 101, 1, 5, 0, 1, 0, 0, 0),
        ("attack", 200, 2, 80, 0, 0, 1, 0, 1),
        ("attack", 205, 1, 6, 0, 1, 0, 0, 0),
        ("normal", 205, 1, 9, 1, 0, 0, 0, 0),
    ]


def test_closed_buckets_wider_than_a_second(spark, place):
    folders, arrive = place
    arrive(3)
    stream = traffic.stream_captures(spark, folders)
    assert stream.isStreaming
    closed = traffic.closed_buckets(stream, width=60)
    assert closed.columns == ["capture", "second", "packets", "bytes", "HTTP", "TCP", "ICMP", "UDP", "others"]
    batch = read_captures(spark, {"attack": folders["attack"]})
    assert batch.count() == 6
    assert rows(traffic.closed_buckets(batch, width=60)) == rows(rates.traffic_per_bucket(batch, 60))
