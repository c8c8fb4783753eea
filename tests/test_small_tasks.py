"""Tasks stay small where a table is large."""

from lorewell.sources import interactions as I


def test_large_tables_get_more_parts_and_small_ones_keep_theirs(spark, monkeypatch):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "4m")
        assert I.small_tasks(spark.range(100)).count() == 100 and [spark.conf.get(n) for n in names] == ["4m", before[1]]
        spark.conf.set(names[0], "64MB")
        monkeypatch.setattr(I, "TASK_ROWS", 10)
        I.small_tasks(spark.range(101))
        assert [spark.conf.get(n) for n in names] == [str(I.TASK_BYTES), "11"]
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
