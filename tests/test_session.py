from pathlib import Path

from fieldflow.session import cut_lineage, drop_scratch, shared_folder


def test_intermediates_go_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert folder in cut_lineage(spark.range(3), "three").inputFiles()[0]


def test_written_tables_can_be_dropped(spark):
    path = cut_lineage(spark.range(3), "gone").inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert Path(path).exists() and drop_scratch(spark) and not Path(path).exists()
