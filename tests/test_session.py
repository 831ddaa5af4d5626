"""The shared folder."""

import os

from terrafold import session


def test_tables_are_written_read_and_discarded(spark):
    session.discard(spark)
    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5 and session.plan_bytes(df) > 0
    assert session.shared_dir(spark).startswith("file://")
    path = session._MADE[-1].removeprefix("file://")
    assert os.path.isdir(path)
    assert session.discard(spark) == 1 and not os.path.exists(path) and session.discard(spark) == 0


def test_sizes_without_statistics(spark):
    odd = spark.range(3).rdd.map(tuple).toDF(["x"])
    assert 0 < session.plan_bytes(odd) < 1 << 40
