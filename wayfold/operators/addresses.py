"""Operators on component addresses: parsing, completion, matching, scoring."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.names import STATES
from wayfold.functions.postal import DIRECTIONS, MARKED, PLAIN, SLIPS, STREET_TYPES, city_form, line_form
from wayfold.functions.text import SOUNDS, levenshtein_similarity
from wayfold.runtime import bounded_rows

# Weights and thresholds of the similarity of two addresses.
WEIGHTS = {"number": 0.25, "name": 0.30, "zip": 0.20, "city": 0.10, "state": 0.10, "urbanization": 0.15}
THRESHOLDS = {"name": 0.70, "city": 0.80, "urbanization": 0.65}
# Weights of the confidence in a validated address.
CONFIDENCE = {"number": 0.20, "name": 0.25, "type": 0.05, "city": 0.15, "state": 0.15, "zip": 0.15, "unit": 0.03, "urbanization": 0.02}
# ZIP prefixes of Puerto Rico.
PR_PREFIXES = ("006", "007", "008", "009")
TYPES = "|".join(sorted(STREET_TYPES, key=lambda t: (-len(t), t)))
POINTS = "|".join(sorted({*DIRECTIONS, *DIRECTIONS.values()}, key=lambda t: (-len(t), t)))
UNIT = r"(?:apartment|apt|suite|ste|unit|un)\.?\s*#?\s*([0-9]+[a-z]?|[a-z])\b|#\s*([0-9]+[a-z]?)"


def table_of(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def normal_state(state: Column) -> Column:
    """The code of a state given as code or name; null if it is none."""
    t = F.trim(F.regexp_replace(F.lower(state), r"[^a-z]+", " "))
    joined = F.replace(t, F.lit(" "), F.lit(""))
    codes = table_of({v.lower(): v for v in STATES.values()})
    return F.coalesce(table_of(STATES)[t], codes[joined])


def zip5(zip_: Column) -> Column:
    """Five digits of a ZIP, with or without the four more; else null."""
    five = F.regexp_extract(F.trim(zip_), r"^(\d{5})(?:-?\d{4})?$", 1)
    return F.nullif(five, F.lit(""))


def parse(rows: DataFrame, line: str = "address", city: str = "city", state: str = "state", zip_: str = "zip") -> DataFrame:
    """Adds ``number``, ``direction``, ``name``, ``type``, ``unit``, ``urbanization``, ``place``,
    ``code``, ``zip5`` and ``is_pr``; what isn't there is null."""
    t = F.trim(F.regexp_replace(F.lower(F.col(line)), r"[\s,.]+", " "))
    urb = F.trim(F.regexp_extract(F.lower(F.col(line)), r"\burb(?:anizacion)?\.? ([^,0-9]+)", 1))
    rows = rows.withColumn("_t", F.trim(F.regexp_replace(t, r"\burb(?:anizacion)? [^0-9]+", " ")))
    unit = F.concat(F.regexp_extract("_t", UNIT, 1), F.regexp_extract("_t", UNIT, 2))
    rows = rows.withColumns({"_u": F.upper(unit), "_s": F.trim(F.regexp_replace(F.regexp_replace("_t", UNIT, " "), r"\s+", " "))})
    pattern = rf"^(\d+)? ?(?:({POINTS}) )?(.*?)(?: ({TYPES}))?(?: ({POINTS}))?$"
    part = lambda i: F.nullif(F.regexp_extract("_s", pattern, i), F.lit(""))
    turn = lambda c: F.coalesce(table_of(DIRECTIONS)[c], c)
    rows = rows.withColumns(
        {
            "number": part(1),
            "direction": F.upper(turn(F.coalesce(part(2), part(5)))),
            "name": part(3),
            "type": F.upper(table_of(STREET_TYPES)[part(4)]),
            "unit": F.nullif("_u", F.lit("")),
            "urbanization": F.nullif(urb, F.lit("")),
            "place": F.nullif(F.trim(F.lower(F.col(city))), F.lit("")),
            "code": normal_state(F.col(state)),
            "zip5": zip5(F.col(zip_)),
        }
    )
    pr = F.coalesce(F.substring("zip5", 1, 3).isin(*PR_PREFIXES), F.lit(False)) | F.coalesce(F.col("code") == "PR", F.lit(False))
    return rows.withColumn("is_pr", pr).drop("_t", "_u", "_s")


def classify(parsed: DataFrame) -> DataFrame:
    """``quality`` and ``confidence`` by what is missing of street, city, state and ZIP."""
    street = F.col("number").isNotNull() & F.col("name").isNotNull()
    missing = sum((F.when(p, 0).otherwise(1) for p in (street, F.col("place").isNotNull(), F.col("code").isNotNull(), F.col("zip5").isNotNull())), F.lit(0))
    anchor = F.col("zip5").isNotNull() | (F.col("place").isNotNull() & F.col("code").isNotNull()) | F.col("name").isNotNull()
    typeless = F.col("name").isNotNull() & F.col("type").isNull()
    no_urb = F.col("is_pr") & F.col("urbanization").isNull()
    base = F.when(missing == 0, 0.95).when(missing == 1, 0.80).when(missing == 2, 0.60).when((missing == 3) & anchor, 0.40).otherwise(0.15)
    confidence = base * F.when((missing == 0) & typeless, 0.9).otherwise(1.0) * F.when(no_urb, 0.8).otherwise(1.0)
    quality = (
        F.when((missing == 0) & typeless, "ambiguous")
        .when((missing == 0) & no_urb, "partial")
        .when(missing == 0, "complete")
        .when((missing <= 2) | ((missing == 3) & anchor), "partial")
        .otherwise("invalid")
    )
    return parsed.withColumns({"missing": missing, "quality": quality, "confidence": F.round(confidence, 6)})


def standard_line(parsed: DataFrame) -> Column:
    """One upper-case line: urbanization, street, unit, CITY, STATE ZIP."""
    street = F.concat_ws(" ", "number", "direction", F.upper("name"), "type")
    unit = F.when(F.col("unit").isNotNull(), F.concat(F.lit("UNIT "), "unit"))
    urb = F.when(F.col("is_pr") & F.col("urbanization").isNotNull(), F.concat(F.lit("URB "), F.upper("urbanization")))
    region = F.nullif(F.concat_ws(" ", "code", "zip5"), F.lit(""))
    place = F.when(F.col("place").isNotNull() & region.isNotNull(), F.concat(F.upper("place"), F.lit(", "), region)).otherwise(F.coalesce(F.upper("place"), region))
    return F.concat_ws(", ", urb, F.nullif(street, F.lit("")), unit, place)


def zip_dimension(rows: DataFrame) -> DataFrame:
    """Per ZIP the most frequent city and state, up to four other cities, the number of rows."""
    c = rows.select(zip5(F.col("zip")).alias("zip"), F.initcap(F.trim("city")).alias("city"), F.upper(F.trim("state")).alias("state")).where("zip is not null and city <> ''")
    n = c.groupBy("zip", "city").agg(F.count("*").alias("n"), F.mode("state", deterministic=True).alias("state"))
    r = F.row_number().over(Window.partitionBy("zip").orderBy(F.desc("n"), "city"))
    n = n.withColumn("r", r)
    agg = n.groupBy("zip").agg(
        F.sum("n").alias("total"),
        F.min_by("city", "r").alias("city"),
        F.min_by("state", "r").alias("state"),
        F.array_sort(F.collect_list(F.when(F.col("r").between(2, 5), F.struct("r", "city")))).alias("others"),
    )
    others = F.array_join(F.transform("others", lambda x: x["city"]), ",")
    return agg.select("zip", "city", "state", others.alias("others"), "total", F.substring("zip", 1, 3).isin(*PR_PREFIXES).alias("is_pr"))


def check_place(rows: DataFrame, dimension: DataFrame, strict: bool = False) -> DataFrame:
    """``state_fits`` and ``city_fits``; an unknown ZIP fits, unless ``strict``."""
    d = dimension.select("zip", F.col("city").alias("d_city"), F.col("state").alias("d_state"), F.col("others").alias("d_others"))
    j = rows.withColumn("_z", zip5(F.col("zip"))).join(d, F.col("_z") == d["zip"], "left").drop(d["zip"])
    unknown = F.lit(not strict)
    same = F.lower(F.trim("city"))
    in_others = F.array_contains(F.split(F.lower("d_others"), ","), same)
    fits = F.coalesce(same == F.lower("d_city"), F.lit(False)) | F.coalesce(in_others, F.lit(False))
    return j.withColumns(
        {
            "state_fits": F.when(F.col("d_state").isNull(), unknown).otherwise(F.coalesce(F.upper(F.trim("state")) == F.col("d_state"), F.lit(False))),
            "city_fits": F.when(F.col("d_city").isNull(), unknown).otherwise(fits),
        }
    ).drop("_z")


def exact_key(parsed: DataFrame) -> Column:
    """number | name without direction | zip (| urbanization in Puerto Rico); the same for index and probe."""
    name = F.trim(F.regexp_replace("name", rf"^(?:the|{POINTS}) ", ""))
    return F.concat_ws("|", F.coalesce("number", F.lit("")), F.coalesce(name, F.lit("")), F.coalesce("zip5", F.lit("")), F.when(F.col("is_pr"), F.coalesce("urbanization", F.lit(""))))


def _sounds(s: str) -> str:
    import re

    s = re.sub("[^A-Z]", "", s.upper())
    lead = s[:1] if s[:1] in tuple("AEIOU") else ""
    s = reduce(lambda t, r: re.sub(r[0], r[1], t), SOUNDS, s)
    return re.sub(r"(.)\1+", r"\1", lead + s)[:6]


def _soundex(s: str) -> str:
    code = {c: d for d, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    s = [c for c in s.upper() if "A" <= c <= "Z"]
    if not s:
        return "0000"
    out, last = s[0], code.get(s[0])
    for c in s[1:]:
        d = code.get(c)
        if d and d != last:
            out += str(d)
        last = d or last
    return (out + "000")[:4]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@lru_cache(1 << 18)
def best_match(a: str | None, b: str | None, least: float) -> float:
    """The best of matching blocks, edits, sound and prefix; a fifth less below ``least``."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = _sounds(a), _sounds(b)
    sound = 0.4 * (_soundex(a) == _soundex(b)) + (0.6 * SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    scores = [1 - _edits(a, b) / max(len(a), len(b)), sound]
    if a.startswith(b) or b.startswith(a):
        scores.append(min(len(a), len(b)) / max(len(a), len(b)))
    top = max(scores)
    blocks = SequenceMatcher(None, a, b)
    if blocks.real_quick_ratio() > top and blocks.quick_ratio() > top:  # bounds of the ratio
        top = max(top, blocks.ratio())
    return top if top >= least else top * 0.8


def address_similarity(a: dict, b: dict) -> dict[str, float]:
    """Scores of the parts that both addresses have; ``overall`` is their weighted mean."""
    has = lambda k: bool(a.get(k)) and bool(b.get(k))
    s: dict[str, float] = {}
    if has("number"):
        s["number"] = 1.0 if a["number"] == b["number"] else 1 - _edits(a["number"], b["number"]) / max(len(a["number"]), len(b["number"]))
    for k, part in (("name", "name"), ("place", "city")):
        if has(k):
            s[part] = best_match(a[k], b[k], THRESHOLDS[part])
    if has("zip5"):
        x, y = a["zip5"], b["zip5"]
        swapped = sum(p != q for p, q in zip(x, y)) == 2 and sorted(x) == sorted(y) and any(x[i : i + 2] == y[i : i + 2][::-1] != x[i : i + 2][::-1] for i in range(len(x) - 1))
        s["zip"] = 1.0 if x == y else 0.8 if _edits(x, y) == 1 or swapped else 0.0
    if has("code"):
        s["state"] = float(a["code"] == b["code"])
    if a.get("is_pr") and b.get("is_pr") and (a.get("urbanization") or b.get("urbanization")):
        s["urbanization"] = best_match(a["urbanization"], b["urbanization"], THRESHOLDS["urbanization"]) if has("urbanization") else 0.5
    weight = sum(WEIGHTS[k] for k in s)
    return s | {"overall": sum(WEIGHTS[k] * v for k, v in s.items()) / weight if weight else 0.0}


_KEYS = ("number", "name", "place", "code", "zip5", "urbanization", "is_pr")


def similarity(a: str, b: str) -> Column:
    """The overall similarity of two structs of parts, in Arrow batches."""

    @F.pandas_udf("double")
    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        clean = lambda d: [{k: (v if v is not None and v == v else None) for k, v in r.items()} for r in d.to_dict("records")]
        return pd.Series([address_similarity(p, q)["overall"] for p, q in zip(clean(x), clean(y))], index=x.index)

    return score(F.col(a), F.col(b))


def fuzzy_matches(probes: DataFrame, index: DataFrame, probe_id: str, index_id: str, least: float = 0.6, limit: int = 5, same_number: bool = True, itself: bool = True) -> DataFrame:
    """The best index addresses for each parsed probe, by blocks and then by similarity.

    Blocks are the ZIP, else the city and state, and besides the street's name in one
    form; a pair met in several is scored once.  With ``same_number`` a block holds one
    house number only, rows without one are left out and the city counts with a ZIP too.
    Names that meet again in a block are compared once.  Without ``itself`` a pair of
    equal ids is left out before anything is ranked.
    """
    street, city = line_form(F.col("name")), F.concat(city_form(F.col("place")), F.lit("|"), "code")
    if same_number:
        keys = {"zip": F.concat_ws("|", "zip5", "number"), "city": F.concat_ws("|", city_form(F.col("place")), "code", "number"), "street": F.concat_ws("|", street, "number")}
        asked = keys
        probes, index = probes.where("number is not null"), index.where("number is not null")
    else:
        keys = {"zip": F.col("zip5"), "city": city, "street": F.nullif(street, F.lit(""))}
        asked = keys | {"city": F.when(F.col("zip5").isNull(), city)}

    def blocks(df: DataFrame, key: str, name: str, keys: dict[str, Column]) -> DataFrame:
        k = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(n).alias("by"), F.concat(F.lit(n), F.lit(":"), c).alias("key")) for i, (n, c) in enumerate(keys.items())])
        k = F.explode(F.filter(k, lambda x: x["key"].isNotNull()))
        return df.select(F.col(key).alias(f"{name}_id"), F.struct(*_KEYS).alias(name), city.alias(f"{name}_city"), k.alias("k")).select(f"{name}_id", name, f"{name}_city", "k.*")

    pairs = blocks(probes, probe_id, "p", asked).join(blocks(index, index_id, "i", keys).drop("order", "by"), "key")
    if not itself:
        pairs = pairs.where("p_id <> i_id")
    if same_number:
        pairs = pairs.groupBy("p_id", "i_id").agg(F.any_value("p").alias("p"), F.any_value("i").alias("i"), F.min(F.struct("order", "by")).alias("b")).select("p_id", "i_id", "p", "i", "b.*")
    else:  # what the ZIP or else the city has brought together isn't met again by the street
        met = F.when(F.col("p.zip5").isNotNull(), F.col("p.zip5") == F.col("i.zip5")).otherwise(F.col("p_city") == F.col("i_city"))
        pairs = pairs.where((F.col("by") != "street") | ~F.coalesce(met, F.lit(False)))
    scored = pairs.select("p_id", "i_id", F.concat(F.lit("fuzzy_"), "by").alias("match_type"), F.round(similarity("p", "i"), 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("p_id").orderBy(F.desc("score"), "i_id")
    ranked = scored.withColumns({"rank": F.row_number().over(w), "gap": F.col("score") - F.lead("score").over(w)})
    return ranked.where(F.col("rank") <= limit)


def slips_fixed(line: Column) -> tuple[Column, Column]:
    """The line with known slips put right, and how many there were."""
    n = F.lit(0)
    for wrong, right in sorted(SLIPS.items()):
        n = n + F.regexp_count(line, F.lit(rf"(?i)\b{wrong}\b"))
        line = F.regexp_replace(line, rf"(?i)\b{wrong}\b", right)
    return line, n


def component_scores(parsed: DataFrame) -> DataFrame:
    """Scores of the parts against the place of the ZIP (``ref_city``, ``ref_state``), with a confidence and status.

    Present parts score 1; a city or state inferred from the ZIP 0.85 and 0.9; a city
    that differs by its likeness without marks, a state that differs 0; without a type 0.3.
    """
    have = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    city = F.when(F.col("place").isNull(), F.when(F.col("ref_city").isNotNull(), 0.85).otherwise(0.0)).when(F.col("ref_city").isNull() | (F.col("place") == F.col("ref_city")), 1.0).otherwise(levenshtein_similarity(*[F.translate(c, MARKED, PLAIN) for c in ("place", "ref_city")]))
    state = F.when(F.col("code").isNull(), F.when(F.col("ref_state").isNotNull(), 0.9).otherwise(0.0)).when(F.col("ref_state").isNull() | (F.col("code") == F.col("ref_state")), 1.0).otherwise(0.0)
    scores = {"number": have("number"), "name": have("name"), "type": F.when(F.col("type").isNotNull(), 1.0).otherwise(0.3), "city": city, "state": state, "zip": have("zip5")}
    out = parsed.withColumns({f"s_{k}": v for k, v in scores.items()})
    total = sum(CONFIDENCE[k] for k in scores)
    mean = sum((F.col(f"s_{k}") * CONFIDENCE[k] for k in scores), F.lit(0.0)) / total
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), ("name", "place", "code", "zip5"), F.col("number").isNotNull())
    conf = F.when(whole, F.least(F.lit(1.0), mean * 1.05)).otherwise(mean) * F.when(F.col("is_pr") & F.col("urbanization").isNull(), 0.85).otherwise(1.0)
    out = out.withColumn("confidence", F.round(conf, 6))
    inferred = (F.col("s_city") == 0.85) | (F.col("s_state") == 0.9)
    changed = (F.col("s_city") < 1) & (F.col("s_city") > 0) & ~inferred
    status = F.when(F.col("confidence") >= 0.95, "verified").when(changed & (F.col("confidence") >= 0.7), "corrected").when(inferred & (F.col("confidence") >= 0.7), "completed").when(F.col("confidence") >= 0.5, "suggested").otherwise("unverified")
    return out.withColumn("status", status)


def swapped(a: Column, b: Column) -> Column:
    """Whether two texts differ by two neighbours that changed places."""
    n = F.length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return F.coalesce((a != b) & (n == F.length(b)) & (F.size(at) > 0), F.lit(False))


def osa_distance(x: str | None, y: str | None) -> int | None:
    """Edits including swaps of neighbours, each stretch edited once; null with a null."""
    if x is None or y is None:
        return None
    two: list[int] = []
    last = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        now = [i]
        for j, q in enumerate(y, 1):
            v = min(last[j] + 1, now[-1] + 1, last[j - 1] + (p != q))
            if i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        two, last = last, now
    return last[-1]


def osa(a: str, b: str) -> Column:
    """``osa_distance`` of two columns, in Arrow batches."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(p, q) for p, q in zip(x, y)], dtype="Int32", index=x.index)

    return distance(F.col(a), F.col(b))


def streets_like(asked: DataFrame, streets: DataFrame, least: float, limit: int) -> DataFrame:
    """For each (id, zip5, name) the other streets (zip5, street) of its ZIP most like it, with ``similarity`` and ``rank``."""
    s = F.round(levenshtein_similarity(F.col("name"), F.col("street")), 6)
    found = asked.join(streets, "zip5").where("name <> street").select("id", "street", s.alias("similarity")).where(F.col("similarity") >= least)
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "street"))
    return found.withColumn("rank", r).where(F.col("rank") <= limit)


def similar_states(typed: DataFrame, states: DataFrame, least: float = 0.6, limit: int = 3) -> DataFrame:
    """For each text typed for a state the states (code, full) most like it.

    The states, at most 1,000, stand beside each text as one array.
    """
    known = [(r["code"], r["full"]) for r in bounded_rows(states.where("full is not null"), 1000, "states")]
    if not known:
        return typed.limit(0).select("typed", F.lit("").alias("code"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    each = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("full")) for c, n in sorted(known)])
    t = typed.select("typed", F.explode(each).alias("s"))
    t = t.select("typed", "s.code", F.round(levenshtein_similarity(F.col("typed"), F.col("s.full")), 6).alias("similarity")).where(F.col("similarity") >= least)
    r = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("similarity"), "code"))
    return t.withColumn("rank", r).where(F.col("rank") <= limit)


def explained(a: str, b: str) -> Column:
    """Scores of the parts that two structs of parts share, and the overall one, as a map."""

    @F.pandas_udf("map<string,double>")
    def scores(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        clean = lambda d: [{k: (v if v is not None and v == v else None) for k, v in r.items()} for r in d.to_dict("records")]
        return pd.Series([{k: round(v, 6) for k, v in address_similarity(p, q).items()} for p, q in zip(clean(x), clean(y))], index=x.index)

    return scores(F.col(a), F.col(b))


def match_cascade(probes: DataFrame, index: DataFrame, probe_id: str, index_id: str, least: float = 0.5, limit: int = 5) -> DataFrame:
    """(p_id, i_id, match_type, score, rank, parts): exact matches by key; only probes without one go to fuzzy ones.

    ``parts`` explains the score by the parts of both addresses.  A row isn't matched with itself.
    """
    key = lambda df, i, n, p: df.select(F.col(i).alias(n), exact_key(df).alias("k"), F.struct(*_KEYS).alias(p)).where("k not like '|%'")
    exact = key(probes, probe_id, "p_id", "p").join(key(index, index_id, "i_id", "i"), "k").where("p_id <> i_id")
    rank = F.row_number().over(Window.partitionBy("p_id").orderBy("i_id"))
    exact = exact.withColumn("rank", rank).where(F.col("rank") <= limit).select("p_id", "i_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score"), "rank", "p", "i")
    left = probes.join(exact.select(F.col("p_id").alias(probe_id)).distinct(), probe_id, "left_anti")
    fuzzy = fuzzy_matches(left, index, probe_id, index_id, least, limit, same_number=False, itself=False).drop("gap")
    fuzzy = fuzzy.join(probes.select(F.col(probe_id).alias("p_id"), F.struct(*_KEYS).alias("p")), "p_id").join(index.select(F.col(index_id).alias("i_id"), F.struct(*_KEYS).alias("i")), "i_id")
    both = exact.unionByName(fuzzy.select(*exact.columns))
    return both.select("p_id", "i_id", "match_type", "score", "rank", explained("p", "i").alias("parts"))
