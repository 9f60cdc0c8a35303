"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidebook.queries import QUERIES, SQL, flagship

TABLES = ("events", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(map(tuple, found.select(columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    wanted = duck.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert rows == sorted(wanted, key=repr)


def test_flagship_has_every_book(spark, sf_dir):
    assert flagship(spark, sf_dir).count() == 15


def test_scan_is_pruned(spark, tmp_path, sf_dir):
    """Key and segment are partition filters, price and time reach Parquet, other columns are not read."""
    from tidebook.operators.storage import read_history
    from tidebook.plans.planner import plan
    from tidebook.queries import FROM, UNTIL, flat_rows
    from tidebook.sources.writers import write_history

    write_history(flat_rows(spark, sf_dir).where("symbol = 'purchase'"), str(tmp_path / "h"))
    out = plan(f"SELECT timestamp, price FROM 'purchase'.'X1' WHERE timestamp BETWEEN {FROM} AND {UNTIL} AND price > 9", read_history(spark, str(tmp_path / "h")))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "segment" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "IsNotNull(price)" in text and "GreaterThanOrEqual(timestamp_ns" in text
    assert "quantity" not in text.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A folder of events whose sides hold up to 1500 prices, more than the 1000 of an evicting side, and DuckDB over it."""
    path = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    con.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_minutes(i * 7) as ts, i // 2 * 3 + 1 as user_id, 'purchase' as event_type, (i * 7919 % 3000) / 4.0 as value,
      '{{"k":' || i % 11 || '}}' as props from range(6000) t(i)) to '{path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    return path, con


#: Queries that lost levels of such sides.
LOST_LEVELS = ("apply_fold", "book_rank", "agg_avg", "agg_depth", "agg_depth_range", "agg_max", "agg_min", "agg_multi", "agg_sum", "agg_vwap", "at_metrics", "book_at", "cumulative_levels", "execute")


@pytest.mark.parametrize("name", LOST_LEVELS)
def test_sides_of_many_prices(spark, crowded, name):
    path, con = crowded
    found = QUERIES[name](spark, path)
    columns = sorted(found.columns)
    wanted = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(wanted, key=repr)


@pytest.fixture(scope="module")
def holed(tmp_path_factory):
    """A folder of events without some values, whose later half has no quantities, and DuckDB over it."""
    path = str(tmp_path_factory.mktemp("holed"))
    con = duckdb.connect()
    con.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_minutes(i * 7) as ts, i // 2 * 3 + 1 as user_id, 'purchase' as event_type, case when i % 13 = 5 then null else i // 4 % 120 * 0.75 + 10 end as value,
      case when i < 480 then '{{"k":' || i % 11 || '}}' end as props from range(1200) t(i)) to '{path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    return path, con


#: Queries in which a null quantity took a level away, or a null price came before the best.
LOST_TO_NULLS = ("book_at", "cumulative_levels", "agg_multi", "execute", "at_metrics", "agg_sum", "agg_vwap", "agg_avg", "agg_depth_range", "agg_min", "agg_depth", "agg_max")


@pytest.mark.parametrize("name", LOST_TO_NULLS)
def test_nulls_as_in_sql(spark, holed, name):
    path, con = holed
    found = QUERIES[name](spark, path)
    columns = sorted(found.columns)
    wanted = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert wanted and sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(wanted, key=repr)


#: Events of odd values: id, time, value and k of row i.
PLAIN = {"id": "i", "time": "timestamp '2024-01-01' + to_minutes(i * 7)", "value": "i // 2 % 20 * 0.75 + 10", "k": "i % 11"}
ODD = {
    "no_price": PLAIN | {"value": "case when (i % 2 = 0) = (i < 202) then null else i // 2 % 20 * 0.75 + 10 end"},  # bids of one book, asks of the other
    "great_prices": PLAIN | {"value": "(i // 2 % 60 + 1) * 14e14"},  # their sums pass 2**63
    "great_quantities": PLAIN | {"k": "(i % 11 + 1) * 500000000000000000"},
    "large_quantities": PLAIN | {"k": "case when i % 2 = 0 then 3 else 9 end * 100000000000000000 + i % 11"},  # only bids and asks together pass 2**63
    "before_zero": PLAIN | {"id": "i - 100"},  # the remainder of a negative id is -1, neither side
    "zoned": PLAIN | {"time": "timestamptz '2024-01-16 05:00:00+00' + to_minutes(i * 3)"},  # read in a session of another zone
    "fractions": PLAIN | {"k": "case i % 3 when 0 then (i % 11)::varchar || '.5' when 1 then (i % 7)::varchar || 'e2' else (i % 5)::varchar || '.25' end"},
}
#: Queries that differed from their SQL on such events.
LOST_TO_ODD = [("agg_max", "no_price"), ("agg_min", "no_price"), ("agg_avg", "no_price"), ("agg_avg", "great_prices"), ("agg_vwap", "no_price"), ("agg_vwap", "great_quantities"), ("agg_multi", "no_price"), ("agg_multi", "large_quantities"), ("agg_multi", "before_zero"), ("execute", "no_price"), ("execute", "large_quantities"), ("execute", "before_zero"), ("at_metrics", "no_price"), ("at_metrics", "great_quantities"), ("at_metrics", "zoned"), ("agg_sum", "fractions"), ("cumulative_levels", "fractions"), ("agg_depth_range", "fractions"), ("agg_depth", "fractions")]


@pytest.fixture
def elsewhere(spark):
    """The session in another zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name, kind", LOST_TO_ODD)
def test_odd_values_as_in_sql(elsewhere, tmp_path, name, kind):
    row, con = ODD[kind], duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"""copy (select {row['id']} as event_id, {row['time']} as ts, i // 2 * 3 + 1 as user_id, case when i < 202 then 'purchase' else 'view' end as event_type, {row['value']} as value,
      '{{"k":' || {row['k']} || '}}' as props from range(400) t(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    found = QUERIES[name](elsewhere, str(tmp_path))
    columns = sorted(found.columns)
    wanted = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert wanted and sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(wanted, key=repr)
