import datetime as dt

import pytest
from strandwise.streaming import streams


def stream(spark, tmp_path, batches):
    schema = "event_id bigint, ts timestamp, user_id bigint, value double"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, at(m), u, v) for e, m, u, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_sessions_and_windows(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, 0, 1, 1.0), (2, 20, 1, 2.0)], [(3, 60, 1, 4.0), (4, 5, 2, 8.0)]])
    got = streams.run(streams.sessions(s, "user_id", gap="30 minutes", delay="2 hours"), str(tmp_path / "a"), "complete")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    w = streams.run(streams.windows(s, width="1 hour", delay="2 hours"), str(tmp_path / "b"), "complete")
    assert sorted((r.n, r.total) for r in w.collect()) == [(1, 4.0), (3, 11.0)]
    b = streams.run(streams.best_of(s, ["user_id"], "value", "event_id", delay="2 hours"), str(tmp_path / "c"), "complete")
    assert sorted((r.user_id, r.event_id) for r in b.collect()) == [(1, 3), (2, 4)]


def test_duplicates_within_the_watermark(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, 0, 1, 1.0), (2, 1, 1, 1.0), (3, 2, 2, 1.0)]])
    got = streams.run(streams.drop_duplicates_within(s, ["user_id"]), str(tmp_path / "a"), "append")
    assert sorted(r.user_id for r in got.collect()) == [1, 2]


def test_disorder_is_an_error(spark, tmp_path):
    assert streams.ordered_or_fail(stream(spark, tmp_path, [[(1, 0, 1, 1.0)]]), "event_id", str(tmp_path / "c")) == 1
    other = tmp_path / "x"
    s = stream(spark, other, [[(5, 0, 1, 1.0)], [(3, 0, 1, 1.0)], [(9, 0, 1, 1.0)], [(1, 0, 1, 1.0)]])
    with pytest.raises(Exception, match="goes back"):
        streams.ordered_or_fail(s, "event_id", str(other / "c"))
