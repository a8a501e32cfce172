"""Times with microseconds, near the ends of hours and of deadlines, against the SQL."""

import duckdb
import pytest

from marlstone.plans import registry

HOUR = 3_600_000_000
#: event_id, microseconds since 1970, user_id; the fold of requests begins with 'ready' or the like by event_id and user.
EVENTS = [(i, 473_352 * HOUR + t, i % 4) for i, t in enumerate([0, 10, 20, 30, HOUR - 1, HOUR - 499, HOUR - 500, HOUR - 501, HOUR, HOUR + 5, HOUR + 499, HOUR + 500, 2 * HOUR - 500, 2 * HOUR + 7, 2 * HOUR + 9] + [2 * HOUR + 100 + k for k in range(12)])]
#: Gaps of six hours, give or take less than a millisecond.
EVENTS += [(100 + 2 * u + k, 473_360 * HOUR + k * (6 * HOUR + 700 * (u % 3 - 1)) + 250 * (u % 4), 50 + u) for u in range(24) for k in (0, 1)]
EVENTS += [(200, 473_400 * HOUR, 99)]


@pytest.mark.parametrize("name", ["ctl_bounded_output", "ctl_output_events", "ctl_job_deadlines", "str_job_deadlines"])
def test_milliseconds_are_those_of_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, make_timestamp(?), ?, 'view', 1.0, '{\"k\": 7}')", EVENTS)
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = registry.queries[name](spark, str(tmp_path))
    theirs = con.execute(registry.oracle_sql[name])
    names = [c[0] for c in theirs.description]
    assert sorted(str(tuple(r)) for r in df.select(names).collect()) == sorted(str(r) for r in theirs.fetchall())
