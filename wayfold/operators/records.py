"""Operators on semi-structured records: cleaning, flattening, schema mapping, gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.runtime import cut

# What stands for a missing value.
EMPTY = ("", "null", "none", "n/a", "na")
#: Words of column names by what they say; a name is told by all of its words.
NUMBER_WORDS = frozenset("num number no nr".split())
NAME_WORDS = frozenset("name names line full text value".split())
COLUMN_WORDS = {
    "house": "house building bldg civic",
    "street": "street str road rd address addr strasse avenue",
    "unit": "unit apt apartment suite ste floor room",
    "city": "city town municipality locality place",
    "state": "state province region st prov",
    "zip": "zip zipcode zip5 postal postcode post plz",
    "country": "country nation",
    "urbanization": "urbanization urb urbanizacion",
    "whole": "full complete whole mailing delivery entire",
}
MEANING = {w: k for k, words in COLUMN_WORDS.items() for w in words.split()}
#: Targets of a mapping, by the order in which they take columns.
TARGETS = ("street_number", "street", "unit", "city", "state", "zip", "country", "urbanization", "full_address")
IDS = ("source_id", "id", "record_id", "address_id", "customer_id", "crid", "uuid", "key", "pk", "external_id")
# Weights of the parts of an address in its completeness.
COMPLETENESS = {"number": 0.15, "name": 0.25, "place": 0.15, "code": 0.15, "zip5": 0.20, "unit": 0.05, "urbanization": 0.05}


def clean_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def cleaned(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; texts trimmed, stand-ins for nothing null.

    Of names that become equal the later ones get a number.
    """
    seen: dict[str, int] = {}
    cols = []
    for i, f in enumerate(df.schema.fields):
        n = clean_name(f.name)
        seen[n] = seen.get(n, 0) + 1
        alias = n if seen[n] == 1 else f"{n}_{seen[n]}"
        c = df[df.columns[i]] if df.columns.count(f.name) == 1 else F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.lower(F.trim(c)).isin(*EMPTY), F.trim(c))
        cols.append(c.alias(alias))
    return df.select(*cols)


def flattened(df: DataFrame, depth: int = 3, sep: str = "_") -> DataFrame:
    """Nested structs as columns, down to a depth; deeper ones and arrays as JSON, empty arrays null."""
    cols: list[Column] = []

    def walk(c: Column, kind: T.DataType, name: str, level: int) -> None:
        if isinstance(kind, T.StructType) and level < depth - 1:
            for f in kind.fields:
                walk(c[f.name], f.dataType, f"{name}{sep}{f.name}" if name else f.name, level + 1)
        elif isinstance(kind, T.ArrayType):
            cols.append(F.when(F.size(c) > 0, F.to_json(c)).alias(name))
        elif isinstance(kind, (T.StructType, T.MapType)):
            cols.append(F.to_json(c).alias(name))
        else:
            cols.append(c.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name, 0)
    return df.select(*cols)


def column_target(name: str) -> str | None:
    """What a column of an address source holds, by the words of its name; null if they don't tell."""
    leaf = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name.split(".")[-1])
    words = re.findall(r"[a-z]+|[0-9]+", leaf.lower())
    if not words or words == ["zip", "5"]:
        return "zip" if words else None
    said = [MEANING.get(w) for w in words]
    means = {m for m in said if m}
    rest = [w for w, m in zip(words, said) if not m]
    numbered, second = any(w in NUMBER_WORDS for w in rest), any(w in ("2", "two") for w in rest)
    if any(w not in NUMBER_WORDS and w not in NAME_WORDS and w not in ("1", "one", "2", "two", "code") for w in rest):
        return None
    if "whole" in means:
        return "full_address" if "street" in means else None
    if "unit" in means or ("street" in means and second):
        return "unit"
    if numbered:
        return "street_number" if means <= {"house", "street"} else None
    for target in ("urbanization", "zip", "city", "state", "country", "street"):
        if means == {target} or (target == "zip" and "zip" in means):
            return target
    return None


def detect_mapping(columns: list[str]) -> dict[str, str]:
    """Target -> source column, by spelling; columns in sorted order, each target once."""
    found: dict[str, str] = {}
    for name in sorted(columns):
        target = column_target(name)
        if target and target not in found:
            found[target] = name
    return found


def mapped_records(df: DataFrame, known: dict[tuple[str, ...], dict[str, str]] | None = None) -> tuple[DataFrame, dict[str, str], float]:
    """The mapped columns of a source, the mapping and its confidence; ``known`` keeps mappings by columns."""
    key = tuple(sorted(df.columns))
    mapping = (known or {}).get(key) or detect_mapping(df.columns)
    if known is not None:
        known[key] = mapping
    return apply_mapping(df, mapping), mapping, mapping_confidence(mapping)


def mapping_confidence(mapping: dict[str, str]) -> float:
    """0.85 for each of street or full address, city, state and zip found, as a mean."""
    want = [{"street", "full_address"}, {"city"}, {"state"}, {"zip"}]
    return round(sum(0.85 for w in want if w & set(mapping)) / len(want), 4)


def apply_mapping(df: DataFrame, mapping: dict[str, str], transforms: dict[str, str] | None = None) -> DataFrame:
    """The mapped columns; a transform is upper, lower, title, strip, zfill5 or regex:<pattern>."""
    out = []
    for target, source in mapping.items():
        c = F.col(source).cast("string")
        t = (transforms or {}).get(target, "")
        if t.startswith("regex:"):
            c = F.nullif(F.regexp_extract(c, t[6:], 1 if "(" in t else 0), F.lit(""))
        elif t:
            c = {"upper": F.upper(c), "lower": F.lower(c), "title": F.initcap(c), "strip": F.trim(c), "zfill5": F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)}[t]
        out.append(c.alias(target))
    return df.select(*out)


def source_id(df: DataFrame, ids: tuple[str, ...] = IDS) -> Column:
    """The first non-empty id column, else 16 hex digits of a hash of the row."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ids if c in df.columns]
    return F.coalesce(*have, F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)))), 1, 16))


def first_given(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty of the columns that there are."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def address_key(df: DataFrame) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce("number", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("place", F.lit("")), F.coalesce("code", F.lit("")), F.coalesce("zip5", F.lit(""))))


def gates(parsed: DataFrame, order: str) -> DataFrame:
    """Quality gates of parsed addresses: ``gates`` (name, passed, score) and ``approved``.

    The first of equal addresses in ``order`` passes the duplicate gate.  Only keys
    are ranked, pre-aggregated to the least order value of a key.
    """
    k = parsed.withColumn("_k", address_key(parsed))
    first = k.groupBy("_k").agg(F.min(order).alias("_first"))
    k = k.join(first, "_k")
    complete = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in COMPLETENESS.items() if c not in ("unit", "urbanization")), F.lit(0.0)) / 0.9
    checks = [
        ("has_street", F.col("name").isNotNull().cast("double"), F.col("name").isNotNull()),
        ("completeness", F.round(complete, 6), complete >= 0.6),
        ("known_state", F.col("code").isNotNull().cast("double"), F.col("code").isNotNull()),
        ("zip_format", F.col("zip5").isNotNull().cast("double"), F.col("zip5").isNotNull()),
        ("pr_urbanization", F.lit(1.0), ~F.col("is_pr") | F.col("urbanization").isNotNull()),
        ("not_duplicate", F.lit(1.0), F.col(order) == F.col("_first")),
    ]
    g = F.array(*[F.struct(F.lit(n).alias("gate"), p.alias("passed"), s.alias("score")) for n, s, p in checks])
    return k.withColumn("gates", g).withColumn("approved", F.forall("gates", lambda x: x["passed"])).drop("_k", "_first")


def folded_confidence(suggestions: DataFrame, key: str, number: str, order: list[str], confidence: str, width: int = 100_000) -> DataFrame:
    """Confidences folded in order of arrival: min(1, 0.6 * so far + 0.5 * new), the first as it is.

    A step is a clamped line, x -> min(top, slope * x + base), and so is any row of
    steps.  A key's suggestions are folded in ranges of ``width`` of ``number``, the first
    of the columns they arrive by, each to one line, then the lines in turn, so that a
    key with many isn't one list.  Rows without number or confidence don't count.
    """
    s = suggestions.where(F.col(number).isNotNull() & F.col(confidence).isNotNull())
    s = s.select(key, F.floor(F.col(number) / width).alias("_part"), F.struct(number, *order, F.col(confidence).cast("double").alias("_c")).alias("_x"))
    parts = s.groupBy(key, "_part").agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_c"]).alias("_a"))
    line = lambda slope, base, top: F.struct(slope.alias("slope"), base.alias("base"), top.alias("top"))

    def lines(a: Column) -> Column:
        step = lambda f, x: line(f["slope"] * 0.6, f["base"] * 0.6 + x * 0.5, F.least(F.lit(1.0), f["top"] * 0.6 + x * 0.5))
        return F.aggregate(a, line(F.lit(1.0), F.lit(0.0), F.lit(float("inf"))), step)

    first = F.get("_a", F.lit(0))
    parts = parts.select(key, "_part", F.size("_a").alias("n"), first.alias("first"), lines(F.slice("_a", 2, F.size("_a"))).alias("rest"), lines(F.col("_a")).alias("all"))
    k = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "first", "rest", "all"))).alias("p"), F.sum("n").cast("int").alias("n"))
    apply_ = lambda f, x: F.least(f["top"], f["slope"] * x + f["base"])
    start = F.get("p", F.lit(0))
    fold = F.aggregate(F.slice("p", 2, F.size("p")), apply_(start["rest"], start["first"]), lambda acc, p: apply_(p["all"], acc))
    return k.select(key, "n", F.round(fold, 6).alias("confidence"))


def latest_unexpired(cache: DataFrame, key: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """The latest row per key (compared without case) that hasn't expired."""
    live = cache.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(seconds)))
    rest = [c for c in cache.columns if c != key]
    g = live.groupBy(F.lower(F.trim(key)).alias(key)).agg(F.max_by(F.struct(*rest), F.struct(ts, F.xxhash64(*rest))).alias("r"))
    return g.select(key, "r.*")


def indexed(df: DataFrame, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Row numbers from 1 in an order, for each value of ``by``, without one task for all.

    Rows are numbered within ranges, which are then offset; a null in ``by`` is a value.
    """
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    if by:
        key = F.xxhash64(F.struct(*by)), F.to_json(F.struct(*by))
        parts = parts.withColumns({"_h": key[0], "_j": key[1]})
        n = parts.groupBy("_h", "_j", "_p").agg(F.count("*").alias("_n"))
        w = Window.partitionBy("_h", "_j")
        on = ["_h", "_j", "_p"]
    else:
        n = parts.groupBy("_p").agg(F.count("*").alias("_n"))
        w = Window.partitionBy()  # one row a range
        on = ["_p"]
    start = n.withColumn("_s", F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(start, on).withColumn("row_no", within + F.coalesce("_s", F.lit(0))).drop("_p", "_n", "_s", "_h", "_j")
