import pytest
from pyspark.sql import functions as F

from pitbars.operators.bars import BAR_COLUMNS
from pitbars.session import scratch_path
from pitbars.sources import readers

from .helpers import quote_bars


def full_bars(spark, start="2024-01-31T23:00", n=30):
    b = quote_bars(spark, [(1, 2, 0.5, 1.5)] * n, minutes=60, start=start).drop("bar_idx", "available_at")
    for c in BAR_COLUMNS:
        if c not in b.columns:
            b = b.withColumn(c, F.col("timestamp") if c.endswith("_timestamp") else F.lit(1.0))
    return b


def test_round_trip_is_half_open_and_prunes_partitions(spark):
    path = scratch_path(spark, "bars")
    readers.write_bars(full_bars(spark), path)
    got = readers.read_bars(spark, path, "2024-01-31", "2024-02-01")
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [is" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_missing_month_and_duplicates_are_errors(spark):
    path = scratch_path(spark, "bars")
    readers.write_bars(full_bars(spark), path)
    with pytest.raises(ValueError, match="2024-03"):
        readers.read_bars(spark, path, "2024-01-01", "2024-04-01")
    readers.write_table(
        full_bars(spark).withColumn("year", F.lit(2024)).withColumn("month", F.month("timestamp")),
        path, ["symbol", "year", "month"], mode="append",
    )
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_bars(spark, path, "2024-01-01", "2024-03-01")


def test_a_month_that_one_symbol_lacks_is_an_error(spark):
    path = scratch_path(spark, "bars")
    readers.write_bars(full_bars(spark), path)
    one = full_bars(spark, start="2024-01-03T00:00", n=2).withColumn("symbol", F.lit("Y"))
    readers.write_table(
        one.withColumn("year", F.lit(2024)).withColumn("month", F.month("timestamp")), path, ["symbol", "year", "month"], mode="append"
    )
    with pytest.raises(ValueError, match="1 missing.*2024-02 of Y"):
        readers.read_bars(spark, path, "2024-01-01", "2024-03-01")


def test_missing_columns_are_errors(spark):
    path = scratch_path(spark, "bars")
    readers.write_bars(full_bars(spark).drop("spread_p95_pips"), path)
    with pytest.raises(ValueError, match="spread_p95_pips"):
        readers.read_bars(spark, path, "2024-01-01", "2024-02-01")


def test_only_missing_months_are_added(spark):
    path = scratch_path(spark, "bars")
    readers.write_bars(full_bars(spark, n=1), path, only_missing=True)
    readers.write_bars(full_bars(spark), path, only_missing=True)
    assert spark.read.parquet(path).count() == 30
    readers.write_bars(full_bars(spark), path, only_missing=True)
    assert spark.read.parquet(path).count() == 30


def test_tick_files_use_a_fixed_zone_in_summer_too(spark):
    path = scratch_path(spark, "ticks")
    rows = [("20240102 170000250,1.25,1.2502,0",), ("20240702 170000000,1.25,1.2502,0",), ("20240702 170000000,1.25,1.2502,0",)]
    spark.createDataFrame(rows, "v string").coalesce(1).write.text(path)
    got = readers.read_ticks_csv(spark, path, symbol="X", pip_size=0.0001)
    out = [r.t for r in got.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("t")).orderBy("t").collect()]
    assert out == ["2024-01-02 22:00:00.250", "2024-07-02 22:00:00.000"]
    assert got.first().spread_pips == pytest.approx(2.0, abs=1e-4)


def test_months_are_replaced_as_a_whole_and_others_stay(spark):
    path = scratch_path(spark, "bars")
    full = full_bars(spark)
    readers.write_bars(full.where("timestamp < '2024-01-20'"), path)  # a half-finished month
    readers.write_bars(full, path)
    want = sorted(map(str, full.select("symbol", "timestamp", "mid_close").collect()))
    read = lambda: sorted(map(str, spark.read.parquet(path).select("symbol", "timestamp", "mid_close").collect()))
    assert read() == want
    readers.write_bars(full, path)
    assert read() == want
    january = full.where("timestamp < '2024-02-01'").limit(1)
    readers.write_bars(january, path)  # replaces January, leaves the other months
    assert len(read()) == 1 + full.where("timestamp >= '2024-02-01'").count()
