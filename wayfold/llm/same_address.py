"""Which address records denote the same location.

Records are parsed into parts.  Token rewrites (abbreviations, slips, words written
together or apart, types and directions taken for words of the name, slips of towns
that aren't listed) are mined from doors that agree elsewhere: same place, number and
other words, one word differing.  A rewrite is kept if the two words resemble each
other and their meeting is statistically significant (likelihood ratio); words are
rewritten and the doors matched again until no new rewrite appears.  Then words met
too rarely for significance follow the one they resemble and meet at half of their
doors, and words that never met another spelling the one far more frequent word like
them.  From then on names compare equal.  Parts left out are filled in where one door fits, and records
without number, name or place denote the only location that fits.

All this is done on distinct written doors; a record takes part as the door it writes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.postal import DIRECTIONS, STREET_TYPES
from wayfold.llm.address_parts import Parser
from wayfold.llm.places import MOST_ENTRIES, Gazetteer, alike, zip_columns
from wayfold.runtime import bounded_rows, cut

#: Likelihood ratio above which a rewrite is significant (0.1 % with one degree of freedom).
SIGNIFICANT = 10.83
#: A slip is met at so many times fewer doors, unless it meets its word at half of its doors.
FEWER = 4

PARTS = ("number", "direction", "type", "unit", "urb", "box", "town", "state", "zip")
TYPE_WORD: dict[str, str] = {}
for _k, _v in STREET_TYPES.items():
    TYPE_WORD.setdefault(_v, _k)
POINT_WORD = {v: k for k, v in DIRECTIONS.items() if len(k) > 2}


def parse_records(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Parts of (id, line, city, state, zip, whole); one row per id, of unequal rows one any."""
    entries = [tuple(r) for r in bounded_rows(reference.select("city_ref_id", "city", "state", "state_name", "zip_low", "zip_high"), MOST_ENTRIES, "canonical places")]
    entries.sort(key=lambda e: (e[0] is None, e[0] or 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(Gazetteer(entries))
        for b in batches:
            rows = []
            for i, line, c, s, z, whole in zip(b["id"], *zip(*zip_columns(b["line"], b["city"], b["state"], b["zip"])), b["whole"]):
                p = parser.parse(line, c, s, z, bool(whole))
                rows.append((i, p["city"], p["name"], *(p[x] for x in PARTS)))
            yield pd.DataFrame(rows, columns=["id", "city", "name", *PARTS])

    one = records.groupBy("id").agg(F.min(F.struct("line", "city", "state", "zip", "whole")).alias("r")).select("id", "r.*")
    return one.where("id is not null").mapInPandas(run, f"id bigint, city bigint, name array<string>, {', '.join(f'{x} string' for x in PARTS)}")


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def all_records(validation: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Both tables as (id, line, city, state, zip, whole), with what was meant where it is given."""
    v = validation.select(
        F.col("id").cast("bigint"),
        F.coalesce(_blank("correct_address"), _blank("correct_street"), F.col("address")).alias("line"),
        F.coalesce(_blank("correct_city"), F.col("city")).alias("city"),
        F.coalesce(_blank("correct_state"), F.col("state")).alias("state"),
        F.coalesce(_blank("correct_zip"), F.col("zip")).alias("zip"),
        F.lit(False).alias("whole"),
    )
    none = F.lit(None).cast("string")
    f = fuzzy.select(F.col("id").cast("bigint"), F.col("input").alias("line"), none.alias("city"), none.alias("state"), none.alias("zip"), F.lit(True).alias("whole"))
    return v.unionByName(f)


def _map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def written_doors(parsed: DataFrame) -> DataFrame:
    """One row for each way a door is written: ``sig``, its parts, ``place`` and the number of records ``n``.

    A place is a listed one, else the town as typed and its state; '?' without either.
    """
    place = F.when(F.col("city") >= 0, F.col("city").cast("string")).when(F.col("town") != "", F.concat(F.lit("?"), "town")).otherwise("?")
    keep = ("city", "name", "number", "direction", "type", "unit", "urb", "box", "town", "state")
    doors = parsed.withColumn("sig", signature()).groupBy("sig").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in keep])
    return doors.withColumn("place", place)


def signature() -> Column:
    return F.md5(F.concat_ws("|", "city", F.array_join("name", " "), "number", "direction", "type", "unit", "urb", "box", "town", "state").cast("binary"))


def _slots(doors: DataFrame) -> DataFrame:
    """(key, word, n), distinct: each word of a door under what the door is without it, and in how many records.

    The others words of the name stand without their vowels.  Two neighbouring words
    are also one slot, as they may be written together.  The street type and the
    direction have slots of their own, in which the last and first word of the name of
    a door without them stand too, and so has a town that isn't listed, marked by @.
    """
    full = doors.where("number <> '' and size(name) > 0 and box = '' and place <> '?'")
    full = full.withColumns({"_t": F.when(F.col("type") != "calle", _map(TYPE_WORD)[F.col("type")]), "_d": _map(POINT_WORD)[F.col("direction")]})
    full = full.select("place", "number", "n", "name", "type", "direction", "town", "state", "_t", "_d", F.size("name").alias("k"), F.expr("transform(name, x -> concat(substring(x, 1, 1), regexp_replace(substring(x, 2), '[aeiouy]', '')))").alias("s"))
    slots = F.expr(
        """concat(
        transform(sequence(0, k - 1), i -> struct(place as at, concat_ws(' ', cast(k as string), cast(i as string), array_join(transform(s, (x, j) -> if(i = j, '*', x)), ' ')) as rest, name[i] as word)),
        if(k > 1, transform(sequence(0, k - 2), i -> struct(place as at, concat_ws(' ', cast(k - 1 as string), cast(i as string), array_join(concat(slice(s, 1, i), array('*'), slice(s, i + 3, k)), ' ')) as rest, concat(name[i], ' ', name[i + 1]) as word)), array()),
        array(if(_t is not null, struct(place as at, concat('T ', array_join(s, ' ')) as rest, _t as word), if(k > 1 and type = '', struct(place as at, concat('T ', array_join(slice(s, 1, k - 1), ' ')) as rest, name[k - 1] as word), null)),
              if(_d is not null, struct(place as at, concat('D ', array_join(s, ' ')) as rest, _d as word), if(k > 1 and direction = '', struct(place as at, concat('D ', array_join(slice(s, 2, k), ' ')) as rest, name[0] as word), null)),
              if(town <> '', struct('' as at, concat('W ', state, ' ', array_join(s, ' ')) as rest, concat('@', town) as word), null)))"""
    )
    each = full.select("number", "n", F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("x"))
    return each.groupBy(F.xxhash64("x.at", "number", "x.rest").alias("key"), F.col("x.word").alias("word")).agg(F.sum("n").alias("n"))


def _plain(word: str) -> Column:
    return F.translate(word, " @", "")


def _grams(plain: str) -> Column:
    return F.expr(f"array_distinct(concat(transform(sequence(1, length({plain}) + 1), i -> substring(concat('^', {plain}, '$'), i, 2)), array(concat('~', array_join(array_sort(split({plain}, '')), '')))))")


def _resembles() -> Column:
    """Whether ``a`` may be a slip or an abbreviation of ``b``."""
    longest = F.greatest(F.length("a"), F.length("b"))
    most = F.when(longest <= 3, 0).when(longest <= 5, 1).when(longest <= 8, 2).otherwise(3)
    bare = [F.regexp_replace(c, "[aeiouy]", "") for c in ("a", "b")]
    short = (F.length("a") >= 3) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & ((bare[0] == bare[1]) | (F.col("a") == bare[1]) | F.col("b").startswith(F.col("a")))
    swapped = (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))) & (F.levenshtein("a", "b") <= 4)
    return (F.levenshtein("a", "b") <= most) | short | swapped


def mine_rewrites(doors: DataFrame) -> DataFrame:
    """New rewrites (``old``, ``new``, ``support``, ``ratio``) of words, mined from written doors.

    Every word is a candidate for every more established one, met at more doors or at as
    many in more records, that stands in its place elsewhere at the same key and resembles it, or is the same in
    two words.  Only words of a key that share a pair of letters, or all letters, are
    compared.  A rewrite must hold in half of the keys in which its word meets a
    resembling one, and its word be met FEWER times less, or meet the new one at half of
    its doors.  Those with a ratio above SIGNIFICANT are mined; the others, of words met
    too rarely to tell, are only worth trying when no more are found.
    """
    slots = _slots(doors).persist()  # what is read twice is kept; rebuilt where an executor is lost
    met = slots.groupBy("word").agg(F.count("*").alias("doors"), F.sum("n").alias("records"))
    key = Window.partitionBy("key")
    many = slots.join(met, "word").withColumns({"others": F.count("*").over(key)}).where("others > 1")
    many = cut(many.select("key", "word", "doors", "records", _plain("word").alias("a")))
    total = float(slots.count())
    slots.unpersist()
    many = many.withColumn("grams", _grams("a"))
    one = many.where("not contains(word, ' ')").where(~F.col("word").isin([*STREET_TYPES, *DIRECTIONS]))
    one = one.select("key", "word", "doors", "records", "a", "grams", F.explode("grams").alias("gram"))
    two = many.where("records > 1 or contains(word, ' ')")
    two = two.select("key", F.col("word").alias("new"), F.col("doors").alias("new_doors"), F.col("records").alias("new_records"), F.col("a").alias("b"), F.col("grams").alias("b_grams"), F.explode("grams").alias("gram"))
    more = (F.col("new_doors") > F.col("doors")) | ((F.col("new_doors") == F.col("doors")) & (F.col("new_records") > F.col("records"))) | ((F.col("a") == F.col("b")) & (F.col("word") != F.col("new")))
    same_kind = F.startswith("word", F.lit("@")) == F.startswith("new", F.lit("@"))
    first = F.get(F.array_intersect("grams", "b_grams"), F.lit(0)) == F.col("gram")  # each pair once
    pairs = one.join(two, ["key", "gram"]).where(more & same_kind).where(first).where(_resembles())
    pairs = cut(pairs.select("key", "word", "new", "doors", "new_doors"))
    found = pairs.groupBy("word", "new").agg(F.count("*").cast("double").alias("a"), F.max("doors").cast("double").alias("w"), F.max("new_doors").cast("double").alias("l"))
    contested = pairs.groupBy("word").agg(F.count_distinct("key").alias("contested"))
    found = found.join(contested, "word").withColumn("n", F.lit(total))
    b, c = F.greatest(F.col("w") - F.col("a"), F.lit(0.0)), F.greatest(F.col("l") - F.col("a"), F.lit(0.0))
    d = F.greatest(F.col("n") - F.col("w") - F.col("l") + F.col("a"), F.lit(1.0))

    def g(o: Column, x: Column, y: Column) -> Column:
        return F.when(o > 0, o * F.log(o * F.col("n") / (x * y))).otherwise(0.0)

    ratio = 2 * (g(F.col("a"), F.col("w"), F.col("l")) + g(b, F.col("w"), F.col("n") - F.col("l")) + g(c, F.col("n") - F.col("w"), F.col("l")) + g(d, F.col("n") - F.col("w"), F.col("n") - F.col("l")))
    held = (F.col("a") * 2 >= F.col("contested")) & ((F.col("l") >= FEWER * F.col("w")) | (F.col("a") * 2 >= F.col("w")))
    found = found.withColumn("ratio", ratio).withColumn("sure", F.col("ratio") > SIGNIFICANT).where(held & (F.col("sure") | (F.col("a") * 2 >= F.col("w"))))
    best = F.max_by(F.struct("new", "a", "ratio"), F.struct("sure", "a", "l", "new"))
    return cut(found.groupBy("word").agg(best.alias("r")).select(F.col("word").alias("old"), "r.new", F.col("r.a").cast("bigint").alias("support"), "r.ratio"))


def respellings(doors: DataFrame) -> DataFrame:
    """(old, new) of words that no key shows beside another spelling of theirs.

    The one word within two edits, one in words of up to five letters, or the same but
    for its vowels, that is met at FEWER times as many doors; of several the nearest, if
    it is the only one.
    """
    words = doors.where("number <> ''").select("place", "number", F.explode(F.concat("name", F.when(F.col("town") != "", F.array(F.concat(F.lit("@"), "town"))).otherwise(F.array()))).alias("word"))
    met = words.distinct().groupBy("word").agg(F.count("*").alias("doors"))
    told = doors.where("number = '' or place = '?'").select(F.explode("name").alias("word")).distinct()
    met = met.join(told, "word", "full").select("word", F.coalesce("doors", F.lit(0)).alias("doors"), _plain("word").alias("a"))
    one = met.where(~F.col("word").isin([*STREET_TYPES, *DIRECTIONS]) & (F.length("a") >= 4)).withColumn("grams", _grams("a"))
    one = one.select("word", "doors", "a", "grams", F.explode("grams").alias("gram"))
    two = met.where(F.col("doors") >= FEWER).withColumn("_g", _grams("a"))
    two = two.select(F.col("word").alias("new"), F.col("doors").alias("new_doors"), F.col("a").alias("b"), F.col("_g").alias("b_grams"), F.explode("_g").alias("gram"))
    most = F.when(F.length("a") > 5, 2).otherwise(1)
    same_kind = F.startswith("word", F.lit("@")) == F.startswith("new", F.lit("@"))
    first = F.get(F.array_intersect("grams", "b_grams"), F.lit(0)) == F.col("gram")
    far = (F.col("new_doors") >= FEWER * F.col("doors")) & (F.col("word") != F.col("new")) & (F.abs(F.length("a") - F.length("b")) <= 4)
    bare = [F.regexp_replace(c, "[aeiouy]", "") for c in ("a", "b")]
    vowels = (bare[0] == bare[1]) & (F.length(bare[0]) >= 3) & (F.substring("a", 1, 1) == F.substring("b", 1, 1))
    d = F.levenshtein("a", "b")
    near = one.join(two, "gram").where(far & same_kind & first).withColumn("d", F.when(d <= 1, d).when(vowels, 1).when(d <= most, d)).where("d is not null")
    best = near.groupBy("word").agg(F.min(F.struct("d", "new")).alias("m"), F.sort_array(F.collect_list("d")).alias("ds"))
    only = F.coalesce(F.get("ds", F.lit(1)) > F.get("ds", F.lit(0)), F.lit(True))
    return best.where(only).select(F.col("word").alias("old"), F.col("m.new").alias("new"))


def rewrite(doors: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Replace words of street names, and towns that aren't listed, by their rewrites.

    Only names with a word to be replaced are taken apart and put together again.  A
    last word that is a street type by now, or a first one that is a direction, becomes it.
    """
    names = doors.select("name").distinct()
    words = names.select("name", F.posexplode("name").alias("i", "old"))
    hit = words.join(rewrites.select("old", "new"), "old").groupBy("name").agg(F.collect_list(F.struct("i", "new")).alias("hits"))
    at = F.map_from_entries("hits")
    to = F.flatten(F.transform("name", lambda x, i: F.split(F.coalesce(at[i], x), " ")))
    hit = hit.select("name", to.alias("new_name"))
    hit = hit.withColumns({"_last": _map(STREET_TYPES)[F.element_at("new_name", -1)], "_lead": _map(DIRECTIONS)[F.get("new_name", F.lit(0))], "_k": F.size("new_name")})
    out = doors.join(hit, "name", "left")
    street = (F.col("box") == "") & F.col("_k").isNotNull()
    tail = street & (F.col("type") == "") & F.col("_last").isNotNull() & (F.col("_k") > 1)
    head = street & (F.col("direction") == "") & F.col("_lead").isNotNull() & (F.col("_k") > 1 + tail.cast("int"))
    left = F.slice("new_name", F.lit(1) + head.cast("int"), F.col("_k") - head.cast("int") - tail.cast("int"))
    out = out.withColumns({"type": F.when(tail, F.col("_last")).otherwise(F.col("type")), "direction": F.when(head, F.col("_lead")).otherwise(F.col("direction")), "name": F.coalesce(left, "name")})
    out = out.drop("new_name", "_last", "_lead", "_k")
    towns = rewrites.where("startswith(old, '@')").select(F.substring("old", 2, 1_000_000).alias("town"), F.substring("new", 2, 1_000_000).alias("new_town"))
    out = out.join(towns, "town", "left").withColumn("town", F.coalesce("new_town", "town")).drop("new_town")
    out = out.withColumn("place", F.when(F.startswith("place", F.lit("?")) & (F.col("town") != ""), F.concat(F.lit("?"), "town")).otherwise(F.col("place")))
    return out


def _fits(a: tuple, b: tuple) -> bool:
    return all(x == y or not x or not y for x, y in zip(a, b))


def settle(doors: list[dict]) -> None:
    """Fill in what doors of one place and number leave out, in place: ``direction``,
    ``type``, ``urb``, ``state`` (of a town that isn't listed) and ``unit``.
    """
    names = {tuple(d["name"]) for d in doors}
    streets: dict[tuple, list[dict]] = defaultdict(list)
    for d in doors:
        d["name"] = tuple(d["name"])
        swallowed = (*d["name"], TYPE_WORD.get(d["type"], ""))
        if swallowed in names:  # what was taken for the type is the last word of the name
            d["name"], d["type"] = swallowed, ""
        streets[d["name"]].append(d)
    for same in streets.values():
        _fill(same)


def _fill(doors: list[dict]) -> None:
    """Parts that some doors of one street name leave out."""
    combo = lambda d: (d["direction"], d["type"], d["urb"], d["state"])
    urbs: Counter = Counter()
    for d in doors:
        urbs[d["urb"]] += d["n"]
    lead: list[str] = []
    to: dict[str, str] = {}
    for u, _ in urbs.most_common():
        to[u] = next((x for x in lead if u and x and alike(u, x) >= 0.7), u)
        if to[u] == u:
            lead.append(u)
    for d in doors:
        d["urb"] = to[d["urb"]]
    combos = {combo(d) for d in doors}
    if all(_fits(a, b) for a in combos for b in combos):
        whole = tuple(max(x) for x in zip(*combos))
        for d in doors:
            d["direction"], d["type"], d["urb"], d["state"] = whole
    else:
        above = {c: [x for x in combos if x != c and _fits(c, x) and sum(map(bool, x)) > sum(map(bool, c))] for c in combos}
        units = defaultdict(set)
        for d in doors:
            units[combo(d)].add(d["unit"])
        for d in doors:
            c = combo(d)
            top = [x for x in above[c] if not any(y in above[x] for y in above[c])]
            if len(top) > 1 and d["unit"]:
                top = [x for x in top if d["unit"] in units[x]]
            if len(top) == 1:
                d["to"] = top[0]
        for d in doors:
            if "to" in d:
                d["direction"], d["type"], d["urb"], d["state"] = d.pop("to")
    by: dict[tuple, list[dict]] = defaultdict(list)
    for d in doors:
        by[combo(d)].append(d)
    for same in by.values():
        units = {d["unit"] for d in same}
        if len(units) == 2 and "" in units:
            for d in same:
                d["unit"] = max(units)


def _location(d: dict) -> str:
    where = d["place"] if not d["place"].startswith("?") else f"{d['place'][1:]}/{d['state']}"
    return "|".join((where, d["number"], d["direction"], " ".join(d["name"]), d["type"], d["unit"], d["urb"]))


def settle_doors(doors: DataFrame) -> DataFrame:
    """(sig, location) of every written door with a number, a name and a place.

    Doors of one place, number and first word of the name meet in one group, once for
    each way they are written and however many records write them so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        now = None

        def close() -> pd.DataFrame:
            settle(held)
            return pd.DataFrame([(d["sig"], _location(d)) for d in held], columns=["sig", "location"])

        made = []
        for b in batches:
            for d in b.to_dict("records"):
                key = (d["place"], d["number"], d["lead"])
                if key != now and held:
                    made.append(close())
                    held = []
                now = key
                held.append(d)
            if made:
                yield pd.concat(made)
                made = []
        if held:
            yield close()

    listed = F.when(F.startswith("place", F.lit("?")), F.col("state")).otherwise("")  # of a listed place the state is settled
    doors = doors.select("sig", "place", "number", "direction", "type", "unit", "urb", listed.alias("state"), "name", "n", F.get("name", F.lit(0)).alias("lead"))
    doors = doors.repartition("place", "number", "lead").sortWithinPartitions("place", "number", "lead", "sig")
    return doors.mapInPandas(run, "sig string, location string")


def settle_boxes(boxes: list[dict]) -> None:
    """Settle boxes of one number in unlisted towns: fills ``town`` and ``state`` of each in place.

    The weightiest spelling of a town leads.  A box without a state is that of the only
    like town, of one spelled the same first; where several fit it stays by itself and
    isn't ``sure``, for it is no further location.
    """
    leaders: list[tuple[str, str]] = []
    weight: Counter = Counter()
    for d in boxes:
        weight[d["town"], d["state"]] += d["n"]
    to, sure = {}, {}
    for k in sorted(weight, key=lambda k: (k[1] == "", -weight[k], k)):
        fit = [lead for lead in leaders if (lead[1] == k[1] or not k[1]) and (lead[0] == k[0] or alike(lead[0], k[0]) >= 0.65)]
        if k[1]:
            fit = sorted(fit, key=lambda lead: -alike(lead[0], k[0]))[:1]
        else:
            fit = [lead for lead in fit if lead[0] == k[0]] or fit
        sure[k] = len(fit) <= 1
        if len(fit) != 1:
            leaders.append(k)
            fit = [k]
        to[k] = fit[0]
    for d in boxes:
        d["sure"] = sure[d["town"], d["state"]]
        d["town"], d["state"] = to[d["town"], d["state"]]


def _settled_boxes(boxes: DataFrame) -> DataFrame:
    """(sig, place, town, location, sure) of every written PO box; a listed place is settled as it is."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        found = b.to_dict("records")
        for d in found:
            d["town_was"], d["state_was"] = d["town"], d["state"]
        settle_boxes(found)
        return pd.DataFrame([(d["box"], d["town_was"], d["state_was"], d["town"], d["state"], d["sure"]) for d in found], columns=["box", "town", "state", "s_town", "s_state", "sure"])

    free = boxes.where("startswith(place, '?') and town <> ''").groupBy("box", "town", "state").agg(F.sum("n").alias("n"))
    to = free.groupBy("box").applyInPandas(run, "box string, town string, state string, s_town string, s_state string, sure boolean")
    where = F.concat_ws("/", F.lit("?"), F.coalesce("s_town", "town"), F.coalesce("s_state", "state"))
    location = F.concat_ws("|", F.when(F.startswith("place", F.lit("?")), where).otherwise(F.col("place")), F.lit("po"), "box")
    return boxes.join(to, ["box", "town", "state"], "left").select("sig", "place", "town", location.alias("location"), F.coalesce("sure", F.lit(True)).alias("sure"))


def locations(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, location) of every record that denotes a location."""
    parsed = cut(parse_records(records, reference))
    doors = cut(written_doors(parsed))
    # Every round does away with a word or parts one in two, so it ends.
    while not (new := (found := mine_rewrites(doors)).where(F.col("ratio") > SIGNIFICANT)).isEmpty():
        doors = cut(rewrite(doors, new))
    doors = cut(rewrite(doors, found))
    doors = cut(rewrite(doors, respellings(doors)))
    nowhere = (F.col("place") == "?") & (F.col("town") == "")
    whole = (F.col("box") == "") & (F.col("number") != "") & (F.size("name") > 0)
    boxes = cut(_settled_boxes(doors.where("box <> ''")))
    sure = cut(settle_doors(doors.where(whole & ~nowhere)).unionByName(boxes.where(~nowhere).select("sig", "location")))
    unsure = boxes.where("not sure").select("location").distinct()
    there = sure.select("location").distinct().join(unsure, "location", "left_anti")
    left = doors.where((whole | (F.col("box") != "")) & nowhere | ~whole & (F.col("box") == ""))
    lost = cut(_only_fit(left, there, reference))
    at = F.concat_ws("|", F.concat(F.lit("?/"), "state"), F.when(F.col("box") != "", F.concat_ws("|", F.lit("po"), "box")).otherwise(F.concat_ws("|", "number", "direction", F.array_join("name", " "), "type", "unit", "urb")))
    alone = doors.where((whole | (F.col("box") != "")) & nowhere).select("sig", at.alias("location")).join(lost.select("sig"), "sig", "left_anti")
    known = sure.unionByName(lost).unionByName(alone)
    return parsed.select("id", signature().alias("sig")).join(known, "sig").select("id", "location")


_OPTIONS = ("place", "number", "direction", "name", "type", "unit", "urb", "box", "state")


def _only_fit(left: DataFrame, there: DataFrame, reference: DataFrame) -> DataFrame:
    """(sig, location) of doors that leave out number, name or place, and that exactly one location fits.

    A door looks up the key of all parts it has, by a mask of them; locations are counted
    under the keys that are looked up, found by a semi join before anything is shuffled
    or kept.  A door that names a street is looked up without its state and unlisted
    town; one without street takes both into account, and a location whose state isn't
    known fits any.
    """
    at = F.split("location", r"\|")
    part = lambda i: F.coalesce(F.get(at, F.lit(i)), F.lit(""))
    is_box = part(1) == "po"
    in_town = F.split(F.regexp_replace(part(0), r"^\?/", ""), "/")
    listed = reference.select(F.col("city_ref_id").cast("string").alias("place"), F.col("state").alias("r_state")).dropDuplicates(["place"])
    door = {c: F.when(is_box, "").otherwise(part(i)) for i, c in enumerate(("number", "direction", "name", "type", "unit", "urb"), 1)}
    locs = there.select("location", F.when(F.size(in_town) > 1, in_town[0]).otherwise(part(0)).alias("place"), *[c.alias(n) for n, c in door.items()], F.when(is_box, part(2)).otherwise("").alias("box"), F.get(in_town, F.lit(1)).alias("t_state"))
    locs = locs.join(listed, "place", "left").withColumn("state", F.lower(F.coalesce("t_state", "r_state", F.lit("")))).drop("t_state", "r_state")

    def key(state: Column) -> Column:
        has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        return F.xxhash64("mask", *[F.when(has(i), state if c == "state" else F.col(c)).otherwise(F.lit("*")) for i, c in enumerate(_OPTIONS)])

    street = F.size("name") > 0
    place = F.when(F.col("city") >= 0, F.col("place")).when(~street | (F.col("box") != ""), F.col("town")).otherwise("")
    state = F.when((F.col("city") >= 0) | street & (F.col("box") == ""), "").otherwise(F.lower(F.coalesce("state", F.lit(""))))
    asks = left.withColumns({"place": place, "state": state, "name": F.when(F.col("box") == "", F.array_join("name", " ")).otherwise("")})
    for c in ("number", "direction", "type", "unit", "urb"):  # a box is told by its number alone
        asks = asks.withColumn(c, F.when(F.col("box") == "", F.col(c)).otherwise(""))
    mask = sum((F.when(F.col(c) != "", F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(_OPTIONS)), F.lit(0))
    told = F.concat("name", "number", "unit", "urb", "box")
    asks = asks.where(told != "").withColumn("mask", mask)
    asks = asks.select("sig", "mask", F.explode(F.array_distinct(F.array(key(F.col("state")), key(F.lit(""))))).alias("key"))
    asks = cut(asks)
    masks = [r["mask"] for r in asks.select("mask").distinct().collect()]  # at most one for each subset of the parts
    made = locs.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")) if masks else locs.withColumn("mask", F.lit(0)).limit(0)
    made = made.select(key(F.col("state")).alias("key"), "location").join(asks.select("key").distinct(), "key", "left_semi")
    fits = made.groupBy("key").agg(F.count("*").alias("c"), F.min("location").alias("location"))
    only = asks.select("sig", "key").join(fits, "key").groupBy("sig").agg(F.sum("c").alias("c"), F.min("location").alias("location"))
    return only.where("c = 1").select("sig", "location")


def same_address_pairs(validation: DataFrame, fuzzy: DataFrame, reference: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of distinct ids that denote the same location.

    Rows without id, or without anything that tells a location, are in no pair; an id
    delivered repeatedly counts once.  Empty tables give no pairs.  Other columns are
    not read.  The pairs of a location come from one equi-join on the location.
    """
    found = cut(locations(all_records(validation, fuzzy), reference))
    a, b = found.select(F.col("id").alias("id_a"), "location"), found.select(F.col("id").alias("id_b"), "location")
    return a.join(b, "location").where("id_a < id_b").select("id_a", "id_b")
