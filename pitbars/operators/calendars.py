"""Session calendar and the assignment of events to sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import local_hour_label, micros, minutes_after
from ..params import PERIODS, SESSIONS, Session
from .asof import DAY_SECONDS


def _session_array(sessions: Sequence[Session]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("name"),
                F.lit(s.tz).alias("tz"),
                F.lit(s.open_hour * 60 + s.open_minute).alias("open_minutes"),
                F.lit(s.end_tz).alias("end_tz"),
                F.lit(s.end_hour * 60 + s.end_minute).alias("end_minutes"),
            )
            for s in sessions
        ]
    )


def session_calendar(
    bars: DataFrame,
    sessions: Sequence[Session] = SESSIONS,
    *,
    by: Sequence[str] = ("symbol",),
    observation_minutes: int = 90,
    periods: dict[int, str] | None = None,
) -> DataFrame:
    """One row per session-day for which a base bar starts exactly at the local open.

    Monday to Friday local; ``cutoff_at`` is the session's end (the next session's open or
    the trading-day boundary, in that zone's wall clock). ``periods`` names years; other
    years stay, with a NULL period. A narrow projection of the bars: no shuffle.
    """
    local = F.from_utc_timestamp("timestamp", F.col("_s.tz"))
    src = bars.select(*by, "timestamp").withColumn("_s", F.explode(_session_array(sessions)))
    src = src.withColumn("_local", local).where(
        (F.weekday("_local") < 5)
        & (F.hour("_local") * 60 + F.minute("_local") == F.col("_s.open_minutes"))
    )
    day = F.to_date("_local")
    end_wall = F.timestamp_micros(
        micros(day.cast("timestamp")) + F.col("_s.end_minutes").cast("long") * 60_000_000
    )
    period: Column = F.lit(None).cast("string")
    for year, label in (PERIODS if periods is None else periods).items():
        period = F.when(F.year(day) == year, label).otherwise(period)
    date_text = F.date_format(day, "yyyy-MM-dd")
    return (
        src.select(
            *by,
            F.concat_ws(":", *by, date_text, F.col("_s.name")).alias("opportunity_id"),
            F.col("_s.name").alias("session"),
            date_text.alias("session_date"),
            F.year(day).alias("year"),
            period.alias("period"),
            F.col("timestamp").alias("session_open_at"),
            minutes_after("timestamp", observation_minutes).alias("observation_end_at"),
            F.to_utc_timestamp(end_wall, F.col("_s.end_tz")).alias("cutoff_at"),
        )
        .where("cutoff_at > session_open_at")
    )


def full_session_calendar(bars: DataFrame, *args, **kwargs) -> DataFrame:
    """The calendar with the whole session as observation window."""
    return session_calendar(bars, *args, **kwargs).withColumn(
        "observation_end_at", F.col("cutoff_at")
    )


def assign_to_sessions(
    events: DataFrame,
    opportunities: DataFrame,
    *,
    by: Sequence[str] = ("symbol",),
    until: str = "observation_end_at",
    end_inclusive: bool = False,
    require_known_after_open: bool = False,
) -> DataFrame:
    """Events that start at or after the session open and are known before (or at) its end.

    Interval join on (series, UTC day of the event start); sessions last under a day, so a
    session is copied to at most two days.
    """
    day = F.lit(DAY_SECONDS * 1_000_000)
    lo = F.floor(micros("session_open_at") / day).cast("long")
    hi = F.floor(micros(until) / day).cast("long")
    opp = opportunities.withColumn("_day", F.explode(F.sequence(lo, hi)))
    ev = events.withColumn("_day", F.floor(micros("event_at") / day).cast("long"))
    ends = (
        F.col("available_at") <= F.col(until)
        if end_inclusive
        else F.col("available_at") < F.col(until)
    )
    cond = (F.col("event_at") >= F.col("session_open_at")) & ends
    if require_known_after_open:
        cond = cond & (F.col("available_at") > F.col("session_open_at"))
    return ev.join(opp, [*by, "_day"]).where(cond).drop("_day")


def local_hour(
    df: DataFrame, sessions: Sequence[Session] = SESSIONS, ts: str = "decision_at"
) -> DataFrame:
    """``decision_local_hour``: hour of ``ts`` on the session's own wall clock."""
    zone: Column = F.lit(None).cast("string")
    for s in sessions:
        zone = F.when(F.col("session") == s.name, s.tz).otherwise(zone)
    return df.withColumn("decision_local_hour", local_hour_label(ts, zone))


