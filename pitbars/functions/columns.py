"""Column functions: civil time, identifiers, deterministic draws. All Catalyst built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import FX_BOUNDARY_HOUR, FX_TZ

ISO = "yyyy-MM-dd'T'HH:mm:ssxxx"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Instant as microseconds since the epoch (a long: cheap to bucket and compare)."""
    return F.unix_micros(col(ts))


def iso(ts: Column | str) -> Column:
    return F.date_format(col(ts), ISO)


def clean_double(c: Column | str) -> Column:
    """NaN becomes NULL, so aggregates skip it the way the study's statistics do."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def minutes_after(ts: Column | str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_micros(micros(ts) + m.cast("long") * F.lit(60_000_000))


def anchored_bucket(
    ts: Column | str,
    minutes: Column | int,
    tz: str = FX_TZ,
    boundary_hour: int = FX_BOUNDARY_HOUR,
) -> tuple[Column, Column]:
    """(start, end) of the bucket holding ``ts``; buckets start at the local day boundary.

    The wall clock is shifted back by the boundary, floored, and shifted forward again,
    so a bucket never straddles two local trading days. Wall-clock start and end are
    turned into instants separately: on a clock-change day a bucket is shorter or longer.
    """
    step = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * 60_000_000
    shift = F.lit(boundary_hour * 3_600_000_000)
    wall = F.unix_micros(F.from_utc_timestamp(col(ts), tz)) - shift
    start = wall - F.pmod(wall, step) + shift
    return (
        F.to_utc_timestamp(F.timestamp_micros(start), tz),
        F.to_utc_timestamp(F.timestamp_micros(start + step), tz),
    )


def in_trading_week(
    ts: Column | str, tz: str = FX_TZ, boundary_hour: int = FX_BOUNDARY_HOUR
) -> Column:
    """True when the local *session date* (day ending at the boundary) is Monday to Friday."""
    local = F.unix_micros(F.from_utc_timestamp(col(ts), tz))
    session = F.timestamp_micros(local + F.lit((24 - boundary_hour) * 3_600_000_000))
    return F.weekday(session) < 5


def local_hour_label(ts: Column | str, tz: Column | str) -> Column:
    """``HH:00`` of the wall clock in ``tz`` (a zone name or a column of zone names)."""
    return F.concat(F.date_format(F.from_utc_timestamp(col(ts), tz), "HH"), F.lit(":00"))


def sign_of(direction: Column | str) -> Column:
    """+1.0 for long, -1.0 for short, NULL otherwise."""
    d = col(direction)
    return F.when(d == "long", F.lit(1.0)).when(d == "short", F.lit(-1.0))


def to_trade_direction(direction: Column | str) -> Column:
    d = col(direction)
    return F.when(d == "up", F.lit("long")).when(d == "down", F.lit("short"))


def draw(*parts: Column | int) -> Column:
    """Deterministic pseudo-random integer in [0, 2^60) from integer parts.

    The first 60 bits of the md5 of the parts as text: every change of a part changes all bits, so draws of different
    resamples or slots are unrelated however many there are, and any SQL engine gives the same integers.
    """
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: Coins that one draw holds.
COINS = 60


def coins(seed: int, group: Column, token: Column) -> Column:
    """``COINS`` deterministic fair coins of a row, as the bits of an integer, for a group of resamples."""
    return draw(seed, group.cast("long"), token)


def coin(seed: int, rep: Column, token: Column) -> Column:
    """Deterministic fair coin (0 or 1) of resample ``rep`` for a row: a bit of the draw of its group of resamples."""
    bits = coins(seed, F.floor(rep / COINS), token)
    return F.call_function("getbit", bits, (rep % COINS).cast("int")).cast("int")


def id_token(c: Column | str) -> Column:
    """60-bit integer of an identifier's md5, for order-free set fingerprints."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 15), 16, 10).cast("long")


def hash_direction(event_id: Column | str, seed: int) -> Column:
    """Deterministic coin: low bit of the first byte of sha256("seed:id"); 1 = long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(event_id)), 256)
    bit = F.conv(F.substring(digest, 2, 1), 16, 10).cast("int") % 2
    return F.when(bit == 1, F.lit("long")).otherwise(F.lit("short"))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.when(b.cast("double") != 0, b.cast("double")))


def profit_factor(value: Column | str) -> Column:
    """Sum of gains over absolute sum of losses; NULL without a loss (an aggregate)."""
    v = col(value)
    gain = F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)))
    return F.when(loss > 0, F.try_divide(gain, loss))


def any_null(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out
