"""The intermediate tables every study shares: ticks, base bars, labelled frames.

A ``Study`` holds the lazy tables of one input and cuts lineage once per table that several
branches read (``materialize``), so the ticks are scanned once per study.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_double
from ..operators import bars as B
from ..operators import blocks, labels, regime
from ..operators.calendars import full_session_calendar, session_calendar
from ..params import PERIODS, LabelParams
from ..session import materialize


def quote_ticks(
    df: DataFrame, *, symbol: str, ts: str, seq: str, mid: str, half_spread, pip_size: float
) -> DataFrame:
    """Any event table as ticks: symbol, ts, seq, bid, ask, mid, spread_pips, activity."""
    m = clean_double(mid)
    return df.select(
        F.col(symbol).alias("symbol"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(seq).alias("seq"),
        m.alias("mid"),
        half_spread.alias("_half"),
    ).select(
        "symbol", "ts", "seq",
        (F.col("mid") - F.col("_half")).alias("bid"),
        (F.col("mid") + F.col("_half")).alias("ask"),
        "mid",
        (F.col("_half") * 2 / F.lit(pip_size)).alias("spread_pips"),
        F.lit(1).alias("activity"),
    )


def event_ticks(spark: SparkSession, sf_dir: str, pip_size: float = 0.01) -> DataFrame:
    """Driver table ``events`` as ticks: one series per event type."""
    half = F.lit(0.05) * (F.col("event_id") % 4 + 1)
    return quote_ticks(
        spark.read.parquet(f"{sf_dir}/events.parquet"),
        symbol="event_type", ts="ts", seq="event_id", mid="value",
        half_spread=half, pip_size=pip_size,
    )


def order_ticks(spark: SparkSession, sf_dir: str, pip_size: float = 0.01) -> DataFrame:
    """Driver table ``orders`` as ticks: one series per priority, many ticks per instant."""
    return quote_ticks(
        spark.read.parquet(f"{sf_dir}/orders.parquet"),
        symbol="o_orderpriority", ts="o_orderdate", seq="o_orderkey", mid="o_totalprice",
        half_spread=F.lit(0.05) * (F.col("o_orderkey") % 4 + 1), pip_size=pip_size,
    )


@dataclass
class Study:
    """Lazy tables of one tick source. ``setup`` is the frame signals come from."""

    ticks: DataFrame
    base_minutes: int = 5
    base_name: str = "5min"
    frames: dict[str, int] = field(default_factory=lambda: {"15min": 15, "1H": 60, "4H": 240, "1D": 1440})
    setup: str = "15min"
    params: LabelParams = field(default_factory=LabelParams)
    periods: dict[int, str] = field(default_factory=lambda: dict(PERIODS))  # names of years
    keep: bool = True  # write shared tables (False: stay lazy)

    def _cut(self, df: DataFrame) -> DataFrame:
        return materialize(df) if self.keep else df

    @cached_property
    def base(self) -> DataFrame:
        """Base bars with positions and end times."""
        made = self._cut(B.ticks_to_bars(self.ticks, f"{self.base_minutes} minutes"))
        indexed = blocks.with_bar_index(made, ["symbol"])
        return self._cut(B.as_timeframe(indexed, self.base_name, self.base_minutes))

    @cached_property
    def bars(self) -> DataFrame:
        """All higher timeframes with position, ATR and eligibility."""
        p = self.params
        rolled = self._cut(B.rollup_bars(self.base, self.frames, base_minutes=self.base_minutes))
        indexed = blocks.with_bar_index(rolled, ["symbol", "timeframe"])
        labelled = B.eligible_bars(labels.true_range_atr(indexed, p.atr_period), p.min_coverage)
        return self._cut(labelled)

    @property
    def setup_bars(self) -> DataFrame:
        return self.bars.where(F.col("timeframe") == self.setup)

    @cached_property
    def swings(self) -> DataFrame:
        p = self.params
        return self._cut(
            labels.label_swings(
                self.bars, left=p.swing_left, right=p.swing_right,
                tolerance_pips=p.equal_tolerance_pips, pip_size=p.pip_size,
            )
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self._cut(
            regime.structure_segments(
                self.bars, self.swings, buffer_atr=self.params.break_buffer_atr, cut=self._cut
            )
        )

    @cached_property
    def breaks(self) -> DataFrame:
        return regime.breaks_from_segments(
            self.segments, self.bars, displacement_body_atr=self.params.displacement_body_atr
        )

    @cached_property
    def contexts(self) -> DataFrame:
        return regime.contexts_from_segments(self.segments, self.bars)

    @cached_property
    def gaps(self) -> DataFrame:
        return labels.label_gaps(
            self.bars, min_size_atr=self.params.gap_min_atr, max_age=self.params.gap_max_age
        )

    def calendar(self, full: bool = True) -> DataFrame:
        return (full_session_calendar if full else session_calendar)(self.base, periods=self.periods)
