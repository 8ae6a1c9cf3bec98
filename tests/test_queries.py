"""Every query against its SQL at the smallest scale factor."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query(spark, con, name):
    got, expected = plans.queries()[name](spark, SF), con.sql(plans.oracles()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(map(tuple, got.select(*expected.columns).collect())) == plain(expected.fetchall())


@pytest.fixture(scope="module")
def at_cut(tmp_path_factory):
    """The smallest tables with every seventh event within the minute that begins at CUT, where the driver's have no caller row."""
    from tidemark.plans.replication import CUT

    sf = tmp_path_factory.mktemp("at_cut")
    for t in TABLES:
        if t != "events":
            (sf / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN make_timestamp({CUT} + event_id) ELSE ts END AS ts) FROM '{SF}/events.parquet') TO '{sf}/events.parquet' (FORMAT parquet)")
    return str(sf)


@pytest.mark.parametrize("name", ["x3_changes", "x4_index_entries"])
def test_caller_rows_at_the_cut(spark, at_cut, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at_cut}/{t}.parquet')")
    got, expected = plans.queries()[name](spark, at_cut), c.sql(plans.oracles()[name])
    assert plain(map(tuple, got.select(*expected.columns).collect())) == plain(expected.fetchall())


def test_entries_in_an_hour_that_the_session_zone_skips(spark, tmp_path):
    """Times have no zone: those from 2 to 3 on a spring day stay as they are, also where clocks skip that hour."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-03-10 02:00:00' + to_seconds(3 * event_id) ELSE ts END AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    expected, zone = c.sql(plans.oracles()["x4_index_entries"]), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = plans.queries()["x4_index_entries"](spark, str(tmp_path)).select(*expected.columns).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert plain(map(tuple, got)) == plain(expected.fetchall())


def test_names():
    assert set(plans.oracles()) <= set(plans.queries())
    assert set(plans.queries()) <= set(entry.queries())
    assert {n for n in plans.queries() if n not in plans.oracles()} == {"x4_index_states"}


def test_entry(spark):
    assert entry.entry(spark).count() == 20
