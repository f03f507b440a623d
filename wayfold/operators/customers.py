"""Operators on the customer table: look-up, search, counts, completion, similarity."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPABLE = ("state", "city", "status", "customer_type", "move_count")
RANGEABLE = ("move_count", "last_move", "created_date")
COMPLETABLE = ("name", "address", "city")


def latest(snapshots: DataFrame) -> DataFrame:
    """The current record of each customer: of the last snapshot, the last loaded."""
    rest = [c for c in snapshots.columns if c != "crid"]
    order = F.struct("snapshot_date", "loaded_at", F.xxhash64(*rest))
    best = snapshots.where("crid is not null").groupBy("crid").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select("crid", "r.*")


def crid_candidates(crid: str) -> list[str]:
    """Ids to try in order: the number in 6 digits, in 3, and as typed."""
    crid = crid.strip().upper()
    if not crid.startswith("CRID-"):
        return [crid]
    n = crid.removeprefix("CRID-")
    return list(dict.fromkeys([f"CRID-{n.zfill(6)}", f"CRID-{n.zfill(3)}", crid]))


def lookup(customers: DataFrame, crid: str) -> DataFrame:
    """The first of the candidate ids that exists."""
    tries = crid_candidates(crid)
    place = reduce(lambda a, x: a.when(F.col("crid") == x[1], x[0]), list(enumerate(tries))[1:], F.when(F.col("crid") == tries[0], 0))
    return customers.where(F.col("crid").isin(tries)).withColumn("_p", place).orderBy("_p", "crid").limit(1).drop("_p")


def criteria(
    state: str | None = None,
    city: str | None = None,
    min_moves: int | None = None,
    customer_type: str | None = None,
    has_apartment: bool | None = None,
    status: str | None = None,
    from_state: str | None = None,
) -> Column:
    """Conjunction of the given filters; texts compare without case, cities by containment."""
    p = F.lit(True)
    for c, v in (("state", state), ("customer_type", customer_type), ("status", status)):
        if v:
            p = p & (F.upper(c) == v.strip().upper())
    if city:
        p = p & F.contains(F.lower("city"), F.lit(city.lower()))
    if min_moves:
        p = p & (F.col("move_count") >= min_moves)
    if has_apartment is not None:
        unit = F.contains(F.lower("address"), F.lit("apt")) | F.contains(F.lower("address"), F.lit("unit"))
        p = p & (unit if has_apartment else ~unit)
    if from_state:
        p = p & F.exists("move_history", lambda m: F.upper(m["state"]) == from_state.strip().upper())
    return p


def search(customers: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Matching customers by id, with the ``total`` before the limit."""
    hits = customers.where(criteria(**filters))
    if limit is None:
        return hits
    return hits.orderBy("crid").limit(limit).withColumn("total", hits.agg(F.count("*")).scalar())


def range_search(customers: DataFrame, field: str, low=None, high=None, **filters) -> DataFrame:
    """Rows whose field lies in an inclusive range; null never does."""
    if field not in RANGEABLE:
        raise ValueError(f"field must be one of {RANGEABLE}")
    p = F.col(field).isNotNull()
    if low is not None:
        p = p & (F.col(field) >= F.lit(low))
    if high is not None:
        p = p & (F.col(field) <= F.lit(high))
    return customers.where(p & criteria(**filters))


def criterion(field: str, operator: str, value) -> Column:
    """One {field, operator, value}; a null field and an unknown operator are false."""
    c = F.upper(F.col(field).cast("string"))
    v = str(value).upper()
    p = {
        "equals": lambda: c == v,
        "not_equals": lambda: c != v,
        "contains": lambda: F.contains(c, F.lit(v)),
        "greater_than": lambda: F.col(field) > F.lit(value),
        "less_than": lambda: F.col(field) < F.lit(value),
        "in": lambda: c.isin([str(x).upper() for x in value]),
    }.get(operator, lambda: F.lit(False))()
    return F.coalesce(p, F.lit(False))


def multi_search(customers: DataFrame, criteria_: list[dict], logic: str = "AND") -> DataFrame:
    """All or any of a list of criteria; no criteria match everything."""
    ps = [criterion(c["field"], c["operator"], c["value"]) for c in criteria_]
    return customers.where(reduce(and_ if logic.upper() == "AND" else or_, ps)) if ps else customers


def regex_search(customers: DataFrame, field: str, pattern: str, **filters) -> DataFrame:
    """Unanchored search without case in name, address or city."""
    if field not in COMPLETABLE:
        raise ValueError(f"field must be one of {COMPLETABLE}")
    return customers.where(F.col(field).rlike(f"(?i){pattern}") & criteria(**filters))


def group_by(customers: DataFrame, field: str, **filters) -> DataFrame:
    """Counts of a field's values as text; null counts as UNKNOWN."""
    if field not in GROUPABLE:
        raise ValueError(f"field must be one of {GROUPABLE}")
    value = F.coalesce(F.col(field).cast("string"), F.lit("UNKNOWN")).alias("value")
    return customers.where(criteria(**filters)).groupBy(value).agg(F.count("*").alias("n"))


def autocomplete(customers: DataFrame, field: str, prefix: str, limit: int = 10) -> DataFrame:
    """Values with a prefix, in alphabetical order; cities once, with counts."""
    hits = customers.where(F.startswith(F.lower(field), F.lit(prefix.lower())))
    if field == "city":
        return hits.groupBy(F.lower("city").alias("key")).agg(F.min("city").alias("value"), F.count("*").alias("n")).orderBy("key").limit(limit).select("value", "n")
    return hits.orderBy(F.lower(field), "crid").limit(limit).select("crid", F.col(field).alias("value"))


def autocomplete_fuzzy(customers: DataFrame, field: str, query: str, limit: int = 10) -> DataFrame:
    """Prefix 1 + len(query)/len(value), containment 0.8; each value once, best first."""
    q = query.lower().strip()
    v = F.lower(field)
    score = F.when(F.startswith(v, F.lit(q)), 1 + F.lit(float(len(q))) / F.length(v)).when(F.contains(v, F.lit(q)), F.lit(0.8))
    hits = customers.select("crid", F.col(field).alias("value"), v.alias("key"), score.alias("score")).where("score > 0.65")
    once = hits.groupBy("key").agg(F.min(F.struct("crid", "value", "score")).alias("r"))
    return once.select("r.crid", "r.value", F.round("r.score", 2).alias("score")).orderBy(F.desc("score"), "crid").limit(limit)


def name_similarity(name: Column, query: str) -> Column:
    """Similarity of the first word of a name: equal 1, prefix 0.95, its prefix 0.9, else by edits."""
    q = query.lower().strip()
    first = F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), 1)
    most = F.greatest(F.length(first), F.lit(len(q)))
    shared = sum((F.startswith(first, F.lit(q[:k])).cast("int") for k in range(1, len(q) + 1)), F.lit(0))
    rest = F.least(1 - F.levenshtein(first, F.lit(q)) / most + shared / most * 0.2, F.lit(0.89))
    return F.when(first == q, 1.0).when(F.startswith(first, F.lit(q)), 0.95).when(F.startswith(F.lit(q), first), 0.9).otherwise(rest)


def similar_names(customers: DataFrame, query: str, limit: int = 10, state: str | None = None) -> DataFrame:
    """Distinct names similar to a query (0.5 or more), best first."""
    hits = customers.where(criteria(state=state)).select("crid", "name", F.lower("name").alias("key"), F.round(name_similarity(F.col("name"), query), 6).alias("s")).where("s >= 0.5")
    once = hits.groupBy("key").agg(F.min(F.struct("crid", "name", "s")).alias("r"))
    kind = F.when(F.col("r.s") >= 0.95, "exact").otherwise("similar")
    return once.select("r.crid", "r.name", F.round("r.s", 3).alias("score"), kind.alias("match_type")).orderBy(F.desc("score"), "crid").limit(limit)


def move_timeline(customers: DataFrame) -> DataFrame:
    """One row per move, numbered by date from 1."""
    m = customers.select("crid", F.explode("move_history").alias("m")).select("crid", "m.*").distinct()
    w = Window.partitionBy("crid").orderBy("move_date", "to_address", "city")
    return m.withColumn("step", F.row_number().over(w))


def origin_destination(customers: DataFrame) -> DataFrame:
    """Moves between states: the state of each move and the one before it."""
    t = move_timeline(customers)
    w = Window.partitionBy("crid").orderBy("step")
    moves = t.select("crid", F.lag("state").over(w).alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null")
    return moves.groupBy("from_state", "to_state").agg(F.count("*").alias("moves"), F.count_distinct("crid").alias("customers"))


def page(df: DataFrame, key: list, offset: int, limit: int) -> DataFrame:
    """One page of an ordered table, with total and whether there is more."""
    rows = df.orderBy(*key).offset(offset).limit(limit).withColumn("total", df.agg(F.count("*")).scalar())
    return rows.withColumn("has_more", F.col("total") > offset + limit)


def delta(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys to add and to remove to bring an index up to its source."""
    add = source.select(key).join(index.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    gone = index.select(key).join(source.select(key), key, "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(gone)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows replaced and new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def any_term(customers: DataFrame, text: str, columns: tuple[str, ...] = ("name", "address", "city")) -> DataFrame:
    """Rows that hold any of the first three terms of three letters or more, with how many."""
    terms = [t for t in text.lower().split() if len(t) >= 3][:3]
    hits = [reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False)) for c in columns]).cast("int") for t in terms]
    return customers.withColumn("terms", sum(hits, F.lit(0))).where("terms > 0")


def weighted_search(customers: DataFrame, text: str, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows by the weights of the columns that hold the terms, as a share of all; a top-k, ties by id."""
    weights = weights or {"name": 2, "address": 3, "city": 2}
    terms = text.lower().split()
    score = sum((F.when(F.contains(F.lower(c), F.lit(t)), float(w)).otherwise(0.0) for c, w in weights.items() for t in terms), F.lit(0.0))
    hits = customers.withColumn("score", F.round(score / (sum(weights.values()) * max(1, len(terms))), 6)).where("score > 0")
    return hits.orderBy(F.desc("score"), "crid").limit(limit)


def completion_keys(customers: DataFrame) -> DataFrame:
    """(key, crid, shared): the forms an address may be typed in, and whose it is.

    Customers without address, city or state have no keys.
    """
    c = customers.where("address is not null and city is not null and state is not null")
    zip_ = F.coalesce("zip", F.lit(""))
    full = F.concat("address", F.lit(", "), "city", F.lit(", "), "state")
    forms = [F.concat(full, F.lit(" "), zip_), full, F.concat("address", F.lit(", "), "city"), F.concat("address", F.lit(" "), zip_), F.col("address")]
    keys = c.select("crid", F.explode(F.array_distinct(F.array(*[F.lower(f) for f in forms]))).alias("key"))
    return keys.groupBy("key").agg(F.max("crid").alias("crid"), F.count_distinct("crid").alias("shared"))


def first_found(ways) -> tuple[str, DataFrame]:
    """The name and rows of the first (name, maker of a DataFrame) that isn't empty; else of the last."""
    name, rows = "", None
    for name, make in ways:
        rows = make()
        if not rows.isEmpty():
            break
    return name, rows


def every_address(customers: DataFrame) -> DataFrame:
    """(crid, address), distinct: the current address and both ends of every move; blank ones are none."""
    ends = F.flatten(F.transform(F.coalesce("move_history", F.array()), lambda m: F.array(m["from_address"], m["to_address"])))
    every = customers.select("crid", F.explode(F.array_distinct(F.concat(F.array("address"), ends))).alias("address"))
    return every.where("trim(address) <> ''").distinct()
