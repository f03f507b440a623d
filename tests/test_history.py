"""Histories against a walk in plain Python, and their edge cases."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from wayfold.operators.history import address_history, attribute_history, presence_runs

MOVE = "array<struct<from_address:string,to_address:string,city:string,state:string,zip:string,move_date:date>>"
SCHEMA = f"crid string, address string, city string, state string, zip string, last_move date, created_date date, move_history {MOVE}, snapshot_date date, loaded_at timestamp"
D = dt.date


def snap(crid, day, address, moves=(), last=None, load=0, city="Oakton", state="NJ"):
    when = dt.datetime.combine(day or D(2024, 1, 1), dt.time()) + dt.timedelta(hours=load)
    history = None if moves is None else [(f, t, c, "NJ", None, d) for f, t, c, d in moves]
    return (crid, address, city, state, "07001", last, D(2019, 5, 1), history, day, when)


def found(spark, rows):
    return sorted((r.crid, r.valid_from, r.valid_to) for r in address_history(spark.createDataFrame(rows, SCHEMA)).collect())


def test_runs_over_word_edges(spark):
    numbers = {"a": [0, 1, 2, 60, 61, 62, 63, 200], "b": list(range(3, 60)), "c": list(range(64, 200)), None: [201]}
    rows = [("x", n, v) for v, ns in numbers.items() for n in ns] + [(None, 0, "z")]
    got = {(r.e, r.v, r.first, r.last) for r in presence_runs(spark.createDataFrame(rows, "e string, n bigint, v string"), "e", "n", "v").collect()}
    assert got == {("x", "a", 0, 2), ("x", "a", 60, 63), ("x", "a", 200, 200), ("x", "b", 3, 59), ("x", "c", 64, 199), ("x", None, 201, 201), (None, "z", 0, 0)}


def test_runs_random(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for e in range(30):
        last, start, n = None, 0, rng.choice([1, 5, 70, 300])
        for i in range(n):
            v = rng.choice("abc") if rng.random() < 0.2 or last is None else last
            if last is not None and v != last:
                want.add((e, last, start, i - 1))
                start = i
            last = v
            rows.append((e, i, v))
        want.add((e, last, start, n - 1))
    got = {(r.e, r.v, r.first, r.last) for r in presence_runs(spark.createDataFrame(rows, "e int, n bigint, v string"), "e", "n", "v").collect()}
    assert got == want


def test_spellings_gaps_and_returns(spark):
    a, b = "12 Oak Street Apt 4", "9 Elm Ave"
    rows = [
        snap("A", D(2023, 3, 31), a),
        snap("A", D(2023, 6, 30), "12  OAK ST., apartment 4 "),
        snap("A", D(2023, 12, 31), b, [(a, b, "Oakton", D(2023, 10, 5))], D(2023, 10, 5)),
        snap("A", D(2024, 3, 31), a, None, D(2024, 2, 1)),
    ]
    assert found(spark, rows) == [("A", "2019-05-01", "2023-10-05"), ("A", "2023-10-05", "2024-02-01"), ("A", "2024-02-01", "9999-12-31")]


def test_stays_only_in_histories(spark):
    a, b, c = "1 A St", "2 B St", "3 C St"
    moves = [(b, c, "Oakton", D(2024, 2, 2)), (a, b, "Oakton", D(2024, 1, 1)), (a, b, "Oakton", D(2024, 1, 1))]
    assert found(spark, [snap("A", D(2024, 3, 31), c, moves)]) == [("A", "2019-05-01", "2024-01-01"), ("A", "2024-01-01", "2024-02-02"), ("A", "2024-02-02", "9999-12-31")]
    assert found(spark, [snap("A", D(2024, 3, 31), b, [(None, b, "Oakton", D(2020, 1, 1))])]) == [("A", "2020-01-01", "9999-12-31")]


def test_same_line_in_another_city_is_a_move(spark):
    rows = [snap("A", D(2024, 3, 31), "1 A St", [("1 A St", "1 A St", "Elmton", D(2023, 1, 1))], city="Elmton")]
    assert found(spark, rows) == [("A", "2019-05-01", "2023-01-01"), ("A", "2023-01-01", "9999-12-31")]


def test_last_load_counts_and_repeats_dont(spark):
    rows = [snap("A", D(2024, 3, 31), "1 A St", load=1), snap("A", D(2024, 3, 31), "2 B St", load=5), snap("A", D(2024, 3, 31), "2 B St", load=5)]
    got = address_history(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.line, r.seen) for r in got] == [("2 b st", 1)]


def test_nulls_extra_columns_and_empty(spark):
    rows = [snap(None, D(2024, 3, 31), "1 A St"), snap("A", None, "1 A St"), snap("B", D(2024, 3, 31), None, None), snap("C", D(2024, 3, 31), "", [(None, None, None, None)]), snap("D", D(2024, 3, 31), "1 A St", None, city=None, state=None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "h": F.lit(2), "p": F.lit(3), "first": F.lit(4), "_k": F.lit(5)})
    assert [(r.crid, r.valid_from) for r in address_history(df).collect()] == [("D", "2019-05-01")]
    assert address_history(spark.createDataFrame([], SCHEMA)).count() == 0
    assert address_history(spark.createDataFrame([snap("E", D(2024, 3, 31), "x" * 100_000)], SCHEMA)).count() == 1


def test_one_customer_with_a_third_of_all_rows(spark):
    rows = [snap("A", D(2024, 3, 31), f"{i % 7} A St", load=i % 50) for i in range(600)] + [snap(f"B{i}", D(2024, 3, 31), "1 A St") for i in range(1200)]
    got = defaultdict(int)
    for r in address_history(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.crid] += 1
    assert len(got) == 1201 and set(got.values()) == {1}


def test_attribute_history(spark):
    rows = [("A", 1, "x", 1), ("A", 2, "x", 1), ("A", 3, None, 1), ("A", 5, "x", 1), ("A", 5, "y", 2), (None, 1, "x", 1), ("B", None, "x", 1)]
    df = spark.createDataFrame(rows, "who string, at int, v string, load int").withColumn("_n", F.lit(0))
    got = sorted((r.v or "", r.valid_from, r.valid_to or 0) for r in attribute_history(df, "who", ["v"], "at", "load").collect())
    assert got == [("", 3, 5), ("x", 1, 3), ("y", 5, 0)]
    assert attribute_history(df.limit(0), "who", ["v"], "at").count() == 0
