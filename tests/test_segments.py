"""Weekday and hour profiles by hand-made lines, and their extremes."""

from tillwright.operators import segments


def test_weekday_and_hourly_profiles(four_lines):
    # 2011-12-09 is a Friday, the next day a Saturday.
    days = [(r["weekday"], r["day_name"], float(r["revenue"]), r["orders"], r["units_sold"])
            for r in segments.weekday_profile(four_lines).collect()]
    assert days == [(4, "Friday", 400.0, 3, 35), (5, "Saturday", 200.0, 1, 10)]
    hours = [(r["hour"], float(r["revenue"]), r["customers"]) for r in segments.hourly_profile(four_lines).collect()]
    assert hours == [(9, 400.0, 2), (10, 200.0, 1)]


def test_extremes_of_the_profiles(four_lines):
    days = segments.best_worst(segments.weekday_profile(four_lines), "weekday", "revenue").collect()
    assert {(r["kind"], r["member"], r["value"]) for r in days} == {("best", "4", 400.0), ("worst", "5", 200.0)}
    hours = segments.best_worst(segments.hourly_profile(four_lines), "hour", "revenue").collect()
    assert {(r["kind"], r["member"]) for r in hours} == {("best", "9"), ("worst", "10")}
