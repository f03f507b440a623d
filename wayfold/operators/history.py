"""Histories of changing attributes from snapshots, by presence bitmaps.

The observations of an entity are numbered in order.  For every value of the
attribute (by its hash) one bit is set per observation that shows it; the bits of
62 observations make a word.  A run of consecutive bits is an unbroken stay, found
by shifts and masks; its first and last bits give the period.  An entity without an
observation at some snapshot has no number for it, so gaps don't break runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.postal import city_form, line_form

WORD = 62
END = "9999-12-31"


def presence_runs(observed: DataFrame, entity: str, number: str, value: str, facts: Sequence[str] = ()) -> DataFrame:
    """Runs (``entity``, ``value``, ``first``, ``last``) of consecutive observation numbers.

    ``observed`` has one row per entity and number, numbers 0, 1, 2 ... in order.  A
    null value makes a run like any other; a null entity is an entity.  With ``facts``
    each run has an array ``facts`` of its observations in order: the number as ``n``
    and these columns, so that none has to be joined to it.  If ``observed`` is
    partitioned by the entity, nothing is shuffled.
    """
    word = F.expr(f"cast({number} div {WORD} as int)")
    bit = F.expr(f"shiftleft(1L, cast({number} % {WORD} as int))")
    fact = [F.collect_list(F.struct(F.col(number).cast("long").alias("n"), *facts)).alias("_f")] if facts else []
    maps = observed.groupBy(entity, value, word.alias("_w")).agg(F.bit_or(bit).alias("_b"), *fact)
    w = Window.partitionBy(entity, value).orderBy("_w")
    before = F.when(F.lag("_w").over(w) == F.col("_w") - 1, F.shiftrightunsigned(F.lag("_b").over(w), WORD - 1).bitwiseAND(F.lit(1))).otherwise(F.lit(0))
    after = F.when(F.lead("_w").over(w) == F.col("_w") + 1, F.shiftleft(F.lead("_b").over(w).bitwiseAND(F.lit(1)), WORD - 1)).otherwise(F.lit(0).cast("long"))
    maps = maps.withColumns({"_before": before.cast("long"), "_after": after})
    starts = F.expr("_b & ~(shiftleft(_b, 1) | _before)")
    ends = F.expr("_b & ~(shiftrightunsigned(_b, 1) | _after)")

    def positions(mask: str) -> Column:
        return F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> (shiftrightunsigned({mask}, i) & 1L) = 1L), i -> _w * {WORD}L + i)")

    maps = maps.withColumns({"_s": starts, "_e": ends}).withColumns({"_s": positions("_s"), "_e": positions("_e")})
    flat = [F.flatten(F.sort_array(F.collect_list(c))).alias(c) for c in ("_s", "_e")]
    runs = maps.groupBy(entity, value).agg(*flat, *([F.flatten(F.collect_list("_f")).alias("_f")] if facts else []))
    # Empty arrays sort first and vanish in flatten; the others are ordered by their first position.
    runs = runs.withColumn("_r", F.explode(F.arrays_zip(F.col("_s").alias("first"), F.col("_e").alias("last"))))
    own = [F.array_sort(F.filter("_f", lambda x: x["n"].between(F.col("_r.first"), F.col("_r.last")))).alias("facts")] if facts else []
    return runs.select(entity, value, F.col("_r.first").alias("first"), F.col("_r.last").alias("last"), *own)


def last_loaded(snapshots: DataFrame, keys: Sequence[str], loaded: str) -> DataFrame:
    """Of rows with equal keys the last loaded; equal ones are told apart by their hash.

    Pre-aggregated before the shuffle, so that a key with many loads is no burden.
    """
    rest = [c for c in snapshots.columns if c not in keys]
    order = F.struct(F.col(loaded), F.xxhash64(*rest))
    best = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def attribute_history(snapshots: DataFrame, entity: str, attributes: Sequence[str], snapshot: str, loaded: str | None = None) -> DataFrame:
    """Every version of ``attributes`` of each entity: ``entity``, the attributes, ``valid_from``, ``valid_to``.

    valid_from is the first snapshot that shows the version, valid_to the first one
    that shows the next, null for the last version.  Missing snapshots don't break a
    version, another value does.  Of several rows of an entity and snapshot the last
    loaded counts (any one, told apart by a hash, without ``loaded``).  Null values are
    values; rows without an entity or snapshot don't count; an empty table has no
    versions.  Other columns, whatever their names, are not read.
    """
    cols = [F.col(entity).alias("_id"), F.col(snapshot).alias("_at"), (F.col(loaded) if loaded else F.lit(0)).alias("_load")]
    rows = snapshots.select(*cols, F.struct(*attributes).alias("_v")).where("_id is not null and _at is not null")
    rows = last_loaded(rows, ["_id", "_at"], "_load").withColumn("_h", F.md5(F.to_json("_v", {"ignoreNullFields": "false"}).cast("binary")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_at")) - 1)
    runs = presence_runs(rows, "_id", "_n", "_h", ["_at", "_v"])
    shown = F.get("facts", F.lit(0))
    made = runs.select("_id", "first", shown["_at"].alias("_at"), shown["_v"].alias("_v"))
    upto = F.lead("_at").over(Window.partitionBy("_id").orderBy("first"))
    return made.select(F.col("_id").alias(entity), *[F.col(f"_v.{a}").alias(a) for a in attributes], F.col("_at").alias("valid_from"), upto.alias("valid_to"))


def address_history(snapshots: DataFrame) -> DataFrame:
    """Every address version of each customer from periodic snapshots with move histories.

    Columns: crid, line, city, state (in the form they are compared in), valid_from
    and valid_to (yyyy-MM-dd), ``seen`` (snapshots that show it).  A version is an
    unbroken stay; other spellings are the same address; zip is ignored.

    The observations of a customer are, by date, the entries of all counting
    move histories and the counting snapshots (an entry before a snapshot of the same
    day), and before them the from_address of the earliest entry, where no snapshot
    is older than it.  valid_from is the move date of the entry that leads to the
    stay; without one created_date for the first version, else last_move of the first
    snapshot that shows it or, if that is null, its date.

    Rows without crid or snapshot_date, snapshots without an address and entries
    without date or address show nothing.  Null cities and states compare as empty.
    Repeated rows and entries count once.  An empty table has no versions.
    """
    moves = F.transform("move_history", lambda m: F.struct(*(m[c].alias(c) for c in ("move_date", "to_address", "city", "state", "from_address"))))
    need = ["crid", "address", "city", "state", "last_move", "created_date", moves.alias("moves"), "snapshot_date", "loaded_at"]
    snaps = last_loaded(snapshots.where("crid is not null and snapshot_date is not null").select(*need), ["crid", "snapshot_date"], "loaded_at")

    def place(line: Column, city: Column, state: Column) -> Column:
        return F.struct(line_form(line).alias("line"), city_form(city).alias("city"), F.upper(F.trim(F.coalesce(state, F.lit("")))).alias("state"))

    def event(at: Column, kind: int, p: Column, origin: Column, since: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), p.alias("p"), origin.alias("origin"), since.alias("since"))

    c = {x: F.col(x) for x in ("address", "city", "state", "snapshot_date", "last_move")}
    seen = event(c["snapshot_date"], 2, place(c["address"], c["city"], c["state"]), F.lit(None).cast("string"), F.coalesce(c["last_move"], c["snapshot_date"]))
    seen = F.when(F.trim(c["address"]) != "", F.array(seen)).otherwise(F.array())
    told = F.filter("moves", lambda m: m["move_date"].isNotNull() & (F.trim(m["to_address"]) != ""))
    told = F.transform(told, lambda m: event(m["move_date"], 1, place(m["to_address"], m["city"], m["state"]), F.nullif(line_form(m["from_address"]), F.lit("")), m["move_date"]))
    # From here on a customer's rows, few after the last loads are chosen, are in one partition.
    events = snaps.select("crid", "created_date", F.explode(F.concat(seen, F.coalesce(told, F.array()))).alias("e")).repartition("crid")
    events = events.groupBy("crid", "e.at", "e.kind", "e.p").agg(F.max("e.origin").alias("origin"), F.min("e.since").alias("since"), F.min("created_date").alias("created_date"))
    w = Window.partitionBy("crid")
    events = events.withColumns({"k": F.row_number().over(w.orderBy("at", "kind", "p")), "created": F.min("created_date").over(w)})
    # What the first observation came from, if it is an entry: an observation before it.  An equal
    # line is then one in another city, as it was a move.
    led = (F.col("k") == 1) & (F.col("kind") == 1) & F.col("origin").isNotNull()
    shift = F.max(led.cast("int")).over(w)
    before = F.struct(F.lit(0).alias("kind"), F.struct(F.col("origin").alias("line"), F.lit("").alias("city"), F.lit("").alias("state")).alias("p"), F.col("created_date").alias("since"), F.lit(0).alias("n"))
    itself = F.struct("kind", "p", "since", (F.col("k") - 1 + F.col("shift")).alias("n"))
    events = events.withColumn("shift", shift).select("crid", "created", F.explode(F.when(led, F.array(before, itself)).otherwise(F.array(itself))).alias("e"))
    events = events.select("crid", "created", "e.*").withColumn("h", F.md5(F.concat_ws("|", "p.line", "p.city", "p.state").cast("binary")))
    stays = presence_runs(events, "crid", "n", "h", ["kind", "since", "p", "created"])
    shown = F.filter("facts", lambda x: x["kind"] == 2)
    moved = F.array_min(F.transform(F.filter("facts", lambda x: x["kind"] == 1), lambda x: x["since"]))
    any_ = F.get("facts", F.lit(0))
    start = F.coalesce(moved, F.when(F.col("first") == 0, any_["created"]), F.get(shown, F.lit(0))["since"])
    stays = stays.select("crid", "first", any_["p"].alias("p"), F.size(shown).cast("long").alias("seen"), F.date_format(start, "yyyy-MM-dd").alias("since"))
    upto = F.lead("since").over(Window.partitionBy("crid").orderBy("first"))
    return stays.select("crid", "p.line", "p.city", "p.state", F.col("since").alias("valid_from"), F.coalesce(upto, F.lit(END)).alias("valid_to"), "seen")
