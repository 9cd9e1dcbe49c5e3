"""Column expressions and the size-checked broadcast."""

import contextlib
import io

from pyspark.sql import functions as F

from storeline.functions.expressions import key_as_bigint, quarter_range
from storeline.functions.sizing import bounded_broadcast


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bounded_broadcast_only_under_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(0, 1000).withColumnRenamed("id", "k")
        small = spark.range(0, 5).withColumnRenamed("id", "k")
        side, ok = bounded_broadcast(small, max_rows=10)
        assert ok and "BroadcastHashJoin" in plan(big.join(side, "k"))
        side, ok = bounded_broadcast(big, max_rows=10)
        assert not ok and "BroadcastHashJoin" not in plan(small.join(side, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_key_as_bigint():
    assert key_as_bigint(" 8801 ") == 8801
    assert key_as_bigint("+7") == 7
    assert key_as_bigint("12x") is None
    assert key_as_bigint("1_000") is None
    assert key_as_bigint("") is None
    assert key_as_bigint(str(2 ** 63)) is None


def test_quarter_range_is_half_open(spark):
    start, end = quarter_range("2025-08-31")
    r = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    assert (str(r.s), str(r.e)) == ("2025-07-01 00:00:00", "2025-10-01 00:00:00")
    start, end = quarter_range("2025-12-31")
    r = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    assert (str(r.s), str(r.e)) == ("2025-10-01 00:00:00", "2026-01-01 00:00:00")


def test_quarter_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.lit("2025-05-01 10:00:00").cast("timestamp_ntz").alias("ts")) \
        .write.parquet(path)
    start, end = quarter_range("2025-06-13")
    p = plan(spark.read.parquet(path).filter((F.col("ts") >= start) & (F.col("ts") < end)))
    assert "GreaterThanOrEqual(ts,2025-04-01T00:00)" in p and "LessThan(ts,2025-07-01T00:00)" in p


def test_backslash_in_a_key_is_itself(spark):
    from storeline.functions.expressions import text_match

    df = spark.createDataFrame([("a\\b c",), ("x\\",), ("50% off",), ("axb",)], "name string")
    for key, want in (("a\\b", {"a\\b c"}), ("x\\", {"x\\"}), ("50%", {"50% off"})):
        assert {r[0] for r in df.filter(text_match("name", key)).collect()} == want


def test_shared_folder_is_required_off_local():
    from types import SimpleNamespace

    import pytest
    from storeline.session import ensure_checkpoint_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d),
                          sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(far)
