from pitbars.operators.calendars import session_calendar

from .helpers import quote_bars, rows


def test_years_without_a_name_stay(spark):
    bars = quote_bars(spark, [(1, 2, 0.5, 1.5)] * 24, minutes=60, start="2026-01-05T00:00")
    got = rows(session_calendar(bars), "session", "year", "period")
    assert sorted(got) == [("london", 2026, None), ("new_york", 2026, None)]
    named = session_calendar(bars, periods={2026: "later"})
    assert {r[2] for r in rows(named, "session", "year", "period")} == {"later"}
