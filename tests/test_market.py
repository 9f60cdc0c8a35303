"""Known values, and the closed form against the sequential fold."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.functions.codec import decode_simple8b, encode_simple8b
from tidebook.functions.hashes import FEW, crc32c, crc32c_many, murmur3, murmur3_many
from tidebook.functions.registry import register
from tidebook.functions.metrics import Metric, measure
from tidebook.operators import book as books
from tidebook.operators import placement, storage
from tidebook.plans.dialect import ParseError, format_query, parse
from tidebook.plans.planner import plan
from tidebook.schema import DELTA, FLAT, TidebookError, flatten
from tidebook.session import Store
from tidebook.sources import readers, writers


def flat(spark, rows):
    """Rows (side, price, quantity) of one book, arriving in order."""
    return spark.createDataFrame([("S", "E", 1000 * i, i, s, 0, p, q, 1, i) for i, (s, p, q) in enumerate(rows)], FLAT)


def value(spark, rows, function, *arguments, side=0):
    row = measure(books.book(flat(spark, rows)), [Metric(function, arguments, side, "v")]).first()
    return (0, True) if row is None else (row["v"], row["v_empty"])


@pytest.mark.parametrize(("rows", "call", "wanted"), [
    ([(0, 1, 10), (0, 2, 20), (0, 3, 30)], ("SUM",), (60, False)),
    ([(0, 100, 1), (0, 200, 1), (0, 300, 1)], ("AVG",), (200, False)),
    ([(0, 500, 1), (0, 100, 1), (0, 300, 1)], ("MIN",), (100, False)),
    ([(0, 500, 1), (0, 100, 1), (0, 300, 1)], ("MAX",), (500, False)),
    ([(0, 100, 1), (0, 200, 1)], ("VWAP",), (150_000_000, False)),
    ([(0, 9900, 1), (1, 10100, 1)], ("SPREAD",), (200, False)),
    ([(0, 9900, 1), (1, 10100, 1)], ("MID_PRICE",), (10_000_000_000, False)),
    ([(0, 1, 500), (1, 2, 500)], ("IMBALANCE", 10), (0, False)),
    ([(0, 1, 1), (1, 2, 2)], ("IMBALANCE", 10), (-333_333_333, False)),
    ([(0, 200, 75)], ("DEPTH", 200), (75, False)),
    ([(0, 200, 75)], ("DEPTH", 999), (0, False)),
    ([(0, 100, 10), (0, 200, 20), (0, 300, 30), (0, 400, 40)], ("DEPTH_RANGE", 150, 350), (50, False)),
    ([(0, 3, 10), (0, 2, 20), (0, 1, 30)], ("CUMULATIVE_VOLUME", 2), (30, False)),
    ([(1, 5, 5)], ("SPREAD",), (0, True)),
    ([(1, 5, 5)], ("VWAP",), (0, True)),
    ([(0, -7, 1), (0, -2, 1)], ("AVG",), (-4, False)),
    ([(0, 9, 3), (0, 8, 2), (1, 10, 4), (1, 11, 9), (1, 12, 9)], ("IMBALANCE", 0), (-444_444_444, False)),
])
def test_known_metrics(spark, rows, call, wanted):
    assert value(spark, rows, *call) == wanted


def test_delete_and_latest(spark):
    assert books.book(flat(spark, [(0, 5, 1), (0, 5, 0), (0, 6, 0)])).count() == 0
    row = books.book(flat(spark, [(0, 5, 1), (0, 5, 9)])).first()
    assert (row["quantity"], row["level"]) == (9, 0)


def test_eviction(spark):
    rows = flat(spark, [(0, p, 1) for p in range(1, 1002)])
    got = {r["price"] for r in books.exact(rows).collect()}
    assert len(got) == 1000 and 1001 in got and 1 not in got
    assert not books.closed_form_holds(rows)


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 12), st.integers(0, 3)), max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_side_is_the_naive_fold(rows, most):
    for side in (0, 1):
        own, naive = books.Side(side == 0, most), {}
        for s, p, q in rows:
            if s == side:
                own.apply(p, (q,))
                if q == 0:
                    naive.pop(p, None)
                elif p in naive or len(naive) < most:
                    naive[p] = q
                else:
                    worst = min(naive) if side == 0 else max(naive)
                    if (p > worst) == (side == 0) and p != worst:
                        del naive[worst]
                        naive[p] = q
        assert [x[1:] for x in own.levels()] == sorted(naive.items(), reverse=side == 0)


def test_exact_is_closed_form(spark):
    rng = random.Random(5)
    rows = flat(spark, [(rng.randint(0, 1), rng.randint(1, 40), rng.randint(0, 4)) for _ in range(400)])
    key = ["side", "level", "price", "quantity", "arrival"]
    assert sorted(books.exact(rows).select(key).collect()) == sorted(books.book(rows).select(key).collect())


@pytest.mark.parametrize(("numbers", "gaps"), [([5, 10], 1), ([5, 6], 0), ([0, 9, 10], 0), ([3, 3], 1), ([4, 3], 1)])
def test_gaps(spark, numbers, gaps):
    rows = spark.createDataFrame([("S", "E", n, 0, 0, [(1, 1, 1)], i) for i, n in enumerate(numbers)], DELTA)
    assert books.gaps(rows).count() == gaps


@pytest.mark.parametrize("sql", ["SELECT", "SELECT * FROM", "SELECT * FROM 'A'", "SELECT * FROM 'A'.'N' WHERE timestamp", "GARBAGE QUERY HERE", "SELECT * FROM 'A'.'N' LIMIT",
                                 "SELECT * FROM 'A", "SELECT * FROM 'A'.'N';", "SUBSCRIBE * FROM 'A'.'N' WHERE AT 5", "SELECT DEPTH(*) FROM 'A'.'N'", "SELECT nothing FROM 'A'.'N'"])
def test_parse_errors_say_where(sql):
    with pytest.raises(ParseError, match=r"line \d+, col \d+"):
        parse(sql)


def test_parse():
    q = parse("select vwap(price), SPREAD(*), Imbalance(10) from 'BTC-USD'.'CB'\nwhere TIMESTAMP >= 17")
    assert q.items == ["VWAP(price)", "SPREAD(*)", "IMBALANCE(10)"] and (q.symbol, q.exchange) == ("BTC-USD", "CB")
    assert q.bounds("timestamp") == (17, None)
    q = parse("SELECT timestamp_ns FROM 'A'.'N' WHERE price > 5 AND price < 9 AND price = 7 LIMIT 0")
    assert q.bounds("price") == (7, 7) and q.bounds("price", strict=False) == (7, 9) and q.limit == 0
    assert parse("SELECT vwap(), depth_range(-1, 5) FROM 'A'.'N'").items == ["VWAP(*)", "DEPTH_RANGE(-1, 5)"]


conditions = st.lists(st.one_of(st.tuples(st.sampled_from(["timestamp", "price"]), st.integers(0, 10**19), st.integers(0, 10**19)).map(lambda t: f"{t[0]} BETWEEN {t[1]} AND {t[2]}"),
                                st.tuples(st.sampled_from(["timestamp", "price"]), st.sampled_from(["=", "<", "<=", ">", ">="]), st.integers(-9, 10**10)).map(lambda t: f"{t[0]} {t[1]} {t[2]}")), max_size=4)


@given(conditions, st.sampled_from(["*", "price, side", "SUM(*), DEPTH_RANGE(1, 2)"]), st.one_of(st.none(), st.integers(0, 10**6)))
@settings(max_examples=80, deadline=None)
def test_text_round_trip(where, items, limit):
    sql = f"SELECT {items} FROM 'A.B'.'N'" + (" WHERE " + " AND ".join(where) if where else "") + (f" LIMIT {limit}" if limit is not None else "")
    assert parse(format_query(parse(sql))) == parse(sql)


def test_plan_rules(spark):
    rows = flat(spark, [(0, 5, 1), (0, 6, 2), (1, 9, 3)])
    with pytest.raises(TidebookError) as e:
        plan("SELECT * FROM 'S'.'X'", rows, check_key=True)
    assert e.value.status == "NOT_FOUND"
    with pytest.raises(TidebookError):
        plan("SELECT SUM(*) FROM 'S'.'E' WHERE price > 1", rows)
    with pytest.raises(TidebookError):
        plan("SUBSCRIBE * FROM 'S'.'E'", rows)
    assert plan("SELECT * FROM 'S'.'E' LIMIT 0", rows).count() == 0
    assert plan("SELECT SUM(*) FROM 'S'.'E' WHERE AT 0", rows).first()["sum"] == 1
    assert plan("SELECT price FROM 'S'.'E' WHERE price > 5", rows).columns == ["price"]
    assert plan("SELECT price FROM 'S'.'E' WHERE price > 5", rows).count() == 2
    assert plan("SELECT price FROM 'S'.'E' WHERE price > 5", rows, strict=False).count() == 3
    assert plan("SELECT * FROM 'S'.'E' WHERE timestamp BETWEEN 0 AND 9999999999999999999", rows).count() == 3


def test_segments_and_retention(spark, tmp_path):
    hour = 3_600_000_000_000
    times = [0, 100, 200, hour, hour + 100]
    rows = spark.createDataFrame([("S", "E", t, i, 0, 0, 100 + i, 1, 1, i) for i, t in enumerate(times)], FLAT)
    found = sorted(map(tuple, storage.segments(rows).select("start_ts_ns", "end_ts_ns", "row_count", "first_price").collect()))
    assert found == [(0, 200, 3, 100), (hour, hour + 100, 2, 103)]
    path = str(tmp_path / "h")
    writers.write_history(rows, path)
    history = storage.read_history(spark, path)
    assert storage.scan(history, 0, 500, "S", "E").count() == 3 and storage.scan(history, 500, 999, "S", "E").count() == 0
    assert storage.delete_expired(spark, path, 0) == (0, 0)
    n, size = storage.delete_expired(spark, path, 201)
    assert n == 1 and size > 0 and storage.read_history(spark, path).count() == 2
    files = storage.manifest(spark, path)
    assert files.count() == 1 and '"total_rows":2' in storage.manifest_json(files, 2, 7)


def test_codecs():
    for values in ([], [0] * 500, [1, 2, 3], [(1 << 60) - 2, (1 << 60) - 1, 1 << 60, (1 << 63) - 1], [5] * 7 + [0] * 300):
        assert decode_simple8b(encode_simple8b(values), len(values)) == values


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    assert decode_simple8b(encode_simple8b(values), len(values)) == values


def test_hashes():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    assert [murmur3(x) for x in (b"", b"a", b"abc", b"Hello, world!")] == [0, 0x3C2569B2, 0xB3DD93FA, 0xC0363E43]


def test_ring(spark):
    ring = placement.Ring({"a": 50, "b": 50})
    keys = [f"SYM-{i}" for i in range(400)]
    old = {k: ring.lookup(k) for k in keys}
    assert set(old.values()) == {"a", "b"} and placement.Ring({}).lookup("x") is None
    bigger = placement.Ring({"a": 50, "b": 50, "c": 50})
    frame = spark.createDataFrame(list(old.items()), "symbol_key string, shard string")
    moved = {r["symbol_key"]: r["new_shard"] for r in placement.reassign(frame, bigger).collect()}
    assert moved == {k: bigger.lookup(k) for k in keys if bigger.lookup(k) != old[k]} and set(moved.values()) == {"c"}
    pins = spark.createDataFrame([(k,) for k in list(moved)[:3]], "symbol_key string")
    assert placement.rebalance(frame, bigger, pins).count() == len(moved) - 3
    text = placement.shard_map_json(3, {"A.B": "a"}, {"a": {"address": "h:1", "shard_id": "a", "status": "ACTIVE", "vnodes": 50}})
    assert placement.parse_shard_map(text)["version"] == 3
    for bad in ("[", "{}", placement.shard_map_json(1, {"A.B": "z"}, {})):
        with pytest.raises(TidebookError):
            placement.parse_shard_map(bad)


def test_commands():
    got = readers.parse_commands(["INSERT A N bid 10 5", "insert A N ASK 11 5 3", "INSERT A N up 1 1", "MINSERT B N bid 2", "10050 100 3", "10051 200", "MINSERT B N ask 2", "1 1", "x 1", "MINSERT B N bid 0", "MINSERT B N bid 1001"])
    assert got.deltas == [("A", "N", 0, [(10, 5, 1)]), ("A", "N", 1, [(11, 5, 3)]), ("B", "N", 0, [(10050, 100, 3), (10051, 200, 1)])]
    assert got.rejects == ["INSERT A N up 1 1", "MINSERT B N ask 2", "1 1", "x 1", "MINSERT B N bid 0", "MINSERT B N bid 1001"]


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("symbol,exchange,side,price,qty,count,timestamp_ns\nA,N,bid,10,5,2,77\nA,N,ask,11,5,3,\nA,N,ASK,12,5,,\nA,N,bid,12x,5\nA,N,bid,,5\nA,N\n")
    good, bad = readers.read_csv(spark, str(tmp_path / "in.csv"), now_ns=9)
    assert [tuple(r)[2:] for r in good.drop("sequence_number", "level", "arrival").orderBy("price").collect()] == [(77, 0, 10, 5, 2), (9, 1, 11, 5, 3), (9, 1, 12, 5, 1)]
    assert bad.count() == 3


def test_parallel_arrays(spark):
    rows = spark.createDataFrame([("S", "E", 1, 1, 0, [5, 4], [1, 2], [1, 1], 0), ("S", "E", 2, 1, 7, [5], [1], [1], 1), ("S", "E", 3, 1, 1, [5], [1, 2], [1], 2)],
                                 "symbol string, exchange string, sequence_number long, timestamp_ns long, side int, prices array<long>, qtys array<long>, cnts array<long>, arrival long")
    assert [(r["level"], r["price"]) for r in flatten(readers.parallel_arrays(rows)).orderBy("level").collect()] == [(0, 5), (1, 4)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.insert("AAPL", "NYSE", "bid", [10300, 10200, 10100], [100, 200, 300], [1, 2, 3], timestamp_ns=5) == 1
    assert store.insert("AAPL", "NYSE", "ask", [10400], [50], timestamp_ns=6, seq=9) == 9
    assert store.insert("AAPL", "NYSE", "ask", [10500], [50], timestamp_ns=7) == 10
    assert store.query_all("AAPL", "NYSE").count() == 5
    store.flush()
    store = Store(spark, str(tmp_path / "store"))
    assert [r["price"] for r in store.query_all("AAPL", "NYSE", 3).collect()] == [10300, 10200, 10100]
    assert store.query("SELECT SPREAD(*) FROM 'AAPL'.'NYSE'").first()["spread"] == 100
    assert store.run_commands(["INSERT X N bid 5 5", "nonsense"]) == ["nonsense"]
    assert store.status()["books"] == 2 and store.book().count() == 6
    assert store.query_many("SELECT timestamp, price FROM 'AAPL'.'NYSE'", [("AAPL", "NYSE"), ("X", "N")]).count() == 6
    with pytest.raises(TidebookError):
        store.query("SELECT * FROM 'NO'.'NO'")
    with pytest.raises(ValueError):
        store.insert("A", "N", "bid", [1], [1, 2])
    with pytest.raises(TidebookError):
        store.insert("A", "N", "bid", [1], [1 << 63])
    text = writers.response(store.rows().where("symbol = 'X'"))
    assert text.startswith("OK\ntimestamp_ns\tprice") and writers.parse_response(text)[0]["price"] == 5


def test_subscription_stream(spark, sf_dir, tmp_path):
    """The stream fires for the rows that the batch query finds."""
    from tidebook.queries import ONE, QUERIES, events
    from tidebook.streaming.live import start_subscription

    stream = readers.event_levels(spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet"))
    got = []
    run = start_subscription(stream, f"SUBSCRIBE * FROM {ONE} WHERE price BETWEEN 50 AND 400", lambda df, n: got.extend(r["json"] for r in df.collect()), str(tmp_path / "c"), availableNow=True)
    run.awaitTermination()
    assert len(got) == QUERIES["subscribe"](spark, sf_dir).count() and got[0].startswith('{"ts":')


@pytest.mark.parametrize("count", [0, 1, FEW - 1, 5 * FEW])
def test_hashes_of_many_are_those_of_each(count):
    rng = random.Random(count)
    rows = [rng.randbytes(rng.choice((0, 1, 3, 4, 5, 17, 400))) for _ in range(count)]
    assert crc32c_many(rows).tolist() == [crc32c(x) for x in rows]
    assert murmur3_many(rows).tolist() == [murmur3(x) for x in rows]


def test_functions_of_sql(spark):
    ring = placement.Ring({"a": 8, "b": 8})
    register(spark, ring)
    one = spark.sql("""SELECT crc32c_of('123456789') AS crc, murmur3_of('abc') AS m, crc32c_of(CAST(NULL AS STRING)) AS none, shard_of('X.Y') AS shard,
        unzigzag(zigzag(-9223372036854775807)) AS low, zigzag(-3L) AS z, simple8b_values(simple8b_words(array(1, 2, 300)), 3) AS v""").first()
    assert (one.crc, one.m, one.none, one.shard, one.low, one.z, one.v) == (0xE3069283, 0xB3DD93FA, None, ring.lookup("X.Y"), -9223372036854775807, 5, [1, 2, 300])
