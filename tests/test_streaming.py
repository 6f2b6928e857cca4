"""Streams over tables of one file and of many part files."""

import pytest
from pyspark.errors import StreamingQueryException

from maskframe.plans import catalog
from maskframe.streaming import events


@pytest.fixture(scope="module")
def parts_dir(spark, sf_dir, tmp_path_factory):
    """The events table as a folder of part files, each with ids from everywhere."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5, "event_id").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_windows", "stream_average"])
def test_part_files_equal_one_file(spark, sf_dir, parts_dir, name):
    rows = lambda folder: sorted(map(tuple, catalog.queries()[name](spark, folder).collect()))
    got = rows(parts_dir)
    assert got and got == rows(sf_dir)


def test_ids_out_of_order_are_refused(spark, parts_dir, tmp_path):
    with pytest.raises(StreamingQueryException, match="comes after event"):
        events.drain(events.decayed_average(events.read_events(spark, parts_dir), 0.98), str(tmp_path), "update")
