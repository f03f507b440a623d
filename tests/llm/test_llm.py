"""Operators for training data against brute force, and their edge cases."""

import base64
import bisect
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from compare import check
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import percentiles as P
from wayfold.llm import queries as Q
from wayfold.llm.address_parts import Parser
from wayfold.llm.bpe import DEFAULT_RANKS, PATTERN, Encoder, PairTable, count_tokens, encode_ids
from wayfold.llm.mixing import copies, mix, repetition_rates
from wayfold.llm.places import Gazetteer, clean_zip, edits, map_places
from wayfold.llm.quality import FUNCTIONS, TYPES, describe, learn, start_rates, statistics, text_types
from wayfold.llm.same_address import SIGNIFICANT, mine_rewrites, respellings, rewrite, same_address_pairs, settle
from wayfold.llm.splitting import SPACE, split_documents, split_text


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, tables, name):
    check(spark, Q.QUERIES[name], Q.SQL[name], tables)


# Token ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(DEFAULT_RANKS)


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello  world", "<|endoftext|>", "a" * 5000, "ab " * 3 + "xyzzy" * 1500, "é" * 6000, "naïvé ​﻿ 😀👍🏽 \x0b\x1f\r\n\t", "1234567890" * 50, "don't WE'LL I'm", "\n" * 3000, "中文字符" * 100]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_as_public(encoder, public, text):
    assert encoder.encode([text, None])[0] == public.encode_ordinary(text)
    assert encoder.count([text, None]) == [len(public.encode_ordinary(text)), 0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_ids_of_any_text(encoder, public, text):
    assert encoder.encode([text])[0] == public.encode_ordinary(text)


def test_ids_of_corpus(spark, tables, public):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in Q.p6_ids(spark, tables).collect()}
    assert len(got) == len(want) and all(got[k] == public.encode_ordinary(t or "") for k, t in want.items())


def test_pair_table():
    keys = np.array([(a << 20) | b for a in range(60) for b in range(60)], np.int64)
    t = PairTable(keys, np.arange(len(keys), dtype=np.int32))
    a, b = np.divmod(np.arange(3600), 60)
    assert (t[a, b] == np.arange(3600)).all() and (t[a + 60, b] == 2**31 - 1).all() and (t[a, -1 - b] == 2**31 - 1).all()


def test_ids_edges(spark):
    df = spark.createDataFrame([(None, "x", 1), (1, None, 2), (1, "", 3), (1, "x", 4), (1, "x", 5)], "doc_id bigint, text string, ids int").withColumns({"k": F.lit(1), "t": F.lit(1), "v": F.lit(1)})
    got = sorted((r.doc_id or 0, list(r.ids)) for r in encode_ids(df).collect())
    assert got == [(0, [87]), (1, []), (1, []), (1, [87]), (1, [87])]
    assert encode_ids(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert encode_ids(df.limit(0)).count() == 0 and count_tokens(df.limit(0), ["doc_id"]).count() == 0


# Mixing


def test_rates():
    r = repetition_rates([("a", 0.5, 3, 100), ("b", 0.5, 3, 300)])
    assert r == {"a": 2.0, "b": pytest.approx(2 / 3)}
    r = repetition_rates([("a", 0.6, 2, 10), ("b", 0.3, 9, 90), ("none", 0.1, 5, 0)])
    assert r["a"] == 2.0 and r["b"] * 90 == pytest.approx(80) and r["none"] == 0.0
    assert repetition_rates([]) == {} and repetition_rates([("a", 1.0, 1, 5)]) == {"a": 1.0}
    assert repetition_rates([("a", 0.5, 1, 5), ("b", 0.5, 1, 5)]) == {"a": 1.0, "b": 1.0}


def test_mix(spark):
    rows = [(i, "word " * 20, "big") for i in range(3000)] + [(9000 + i, "word " * 20, "small") for i in range(300)] + [(1, None, "big"), (2, "", "small"), (3, "x", None), (4, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"k": F.lit(0), "s": F.lit(0), "n": F.lit(0), "u": F.lit(0), "uses": F.lit(9)})
    goal = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 4), ("empty", 0.0, 4)], "source string, target_share double, max_repeats int")
    uses, shares = mix(docs, goal)
    s = {r.source: r for r in shares.collect()}
    assert s["big"].actual_share == pytest.approx(0.7, abs=0.03) and s["small"].most_repeats <= 4 and s["empty"].documents == 0
    u = uses.collect()
    assert len(u) == 3300 and sum(r.uses * r.tokens for r in u) == s["big"].mix_tokens + s["small"].mix_tokens
    assert {(r.doc_id, r.uses) for r in mix(docs, goal)[0].collect()} == {(r.doc_id, r.uses) for r in u}
    made = Counter(r.doc_id for r in copies(docs.where("source = 'small' and text <> ''").drop("uses"), uses).collect())
    assert made == {r.doc_id: r.uses for r in u if r.source == "small" and r.uses}
    empty, none = mix(docs.limit(0), goal)
    assert empty.count() == 0 and {r.actual_share for r in none.collect()} == {0.0}
    with pytest.raises(ValueError):
        mix(docs, goal.unionByName(goal))


# Splitting

CUTS = (r"(?:\r\n|\n)(?:[ \t]*(?:\r\n|\n))+[ \t]*", r"[\r\n]+", r"[\r\n]+|(?<=[.!?])[ \t\r\n]+", r"[ \t\r\n]+")


def boundary(text, most):
    for cut, name in zip(CUTS, ("paragraph", "line", "sentence", "word")):
        if max(len(x.strip(SPACE)) for x in re.split(cut, text)) <= most:
            return name
    return "none"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab#.! \t\r\n", max_size=120), st.integers(1, 25), st.integers(0, 12))
def test_split_any_text(text, most, overlap):
    pieces, b = split_text(text, most, overlap)
    if text.strip(SPACE):
        assert b == boundary(text, most)
    at = 0
    for s, e, _ in pieces:
        assert e - s <= most and not text[at:s].strip(SPACE) and e > at
        at = e
    assert not text[at:].strip(SPACE)


def test_split_overlap():
    text = " ".join(f"word{i:03d}" for i in range(300))
    pieces, b = split_text(text, 200, 50)
    assert b == "word" and all(42 <= a[1] - z[0] <= 58 for a, z in zip(pieces, pieces[1:]))
    pieces, b = split_text("x" * 1000, 100, 20)
    assert b == "none" and all(a[1] - z[0] == 20 for a, z in zip(pieces, pieces[1:]))


def test_split_documents(spark):
    rows = [(1, "one two three. four\n\nfive six", "a"), (2, "short", "a"), (3, None, "a"), (4, "", None), (5, "one two three four", None), (6, "   \n" * 20, "zzz"), (5, "one two three four", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, content_type string").withColumns({"k": F.lit(1), "t": F.lit(1), "m": F.lit(1), "piece": F.lit(1)})
    limits = spark.createDataFrame([("a", 20, 0), ("default", 10, 4), ("a", 30, 0), (None, 1, 1), ("b", None, 1)], "content_type string, max_chars int, overlap_chars int")
    got = split_documents(docs, limits).collect()
    assert [(r.piece, r.boundary) for r in got if r.doc_id == 1] == [("one two three. four", "paragraph"), ("five six", "paragraph")]
    assert {r.doc_id for r in got} == {1, 5, 6} and sum(r.doc_id == 5 and r.piece_no == 0 for r in got) == 2
    assert [(r.piece, r.boundary) for r in got if r.doc_id == 6] == [(None, "paragraph")]
    assert split_documents(docs.limit(0), limits).count() == 0 and split_documents(docs, limits.limit(0)).count() == 0


# Percentiles


def brute(xs, p):
    return sorted(xs)[P.rank_of(p, len(xs)) - 1]


def test_ranks():
    assert [P.rank_of(p, 20) for p in (50, 90, 95, 99)] == [10, 18, 19, 20] and P.rank_of(50, 1) == 1 and P.rank_of(0, 5) == 1
    assert P.even_ranks(5, 200) == [1, 2, 3, 4, 5] and P.even_ranks(0, 9) == [] and len(P.even_ranks(10_000, 200)) == 201


@pytest.mark.parametrize("kind", ["heavy", "ties", "few", "negative"])
def test_multi_select(spark, kind, monkeypatch):
    monkeypatch.setattr(P, "READ_OUT", 16)
    rng = random.Random(5)
    make = {"heavy": lambda: int(10 ** rng.uniform(0, 6)), "ties": lambda: rng.choice([1, 1, 1, 7, 9]), "few": lambda: 3, "negative": lambda: rng.gauss(0, 10)}[kind]
    rows = [(rng.choice(["hot", "hot", "b", None]), i % 3, float(make())) for i in range(6000)] + [("hot", 1, None), ("one", 1, 5.0)]
    df = spark.createDataFrame(rows, "g string, d int, x double").repartition(7).withColumns({"cell": F.lit(1), "v": F.lit(1), "c": F.lit(1), "n": F.lit(1), "id": F.lit(1)})
    got = P.percentiles(df, {"g": ["g"], "all": [], "gd": ["g", "d"]}, "x").collect()
    groups: dict = {}
    for g, d, x in rows:
        if x is not None:
            for key in (("g", g, None), ("all", None, None), ("gd", g, str(d))):
                groups.setdefault(key, []).append(x)
    assert len(got) == len(groups)
    for r in got:
        xs = groups[r.grouping, r.g, r.d]
        assert (r.n, r.p50, r.p90, r.p95, r.p99) == (len(xs), *(brute(xs, p) for p in (50, 90, 95, 99)))


def test_many_groups_in_turns(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_RANGES", 10)
    df = spark.createDataFrame([(i % 40, i) for i in range(4000)], "g int, x int")
    got = {r.g: r.p50 for r in P.percentiles(df, {"g": ["g"]}, "x").collect()}
    assert got == {str(g): float(brute([i for i in range(4000) if i % 40 == g], 50)) for g in range(40)}


def test_percentile_edges(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, float("inf")), (2, float("-inf")), (2, -0.0)], "g int, x double")
    got = {r.g: (r.n, r.p50, r.p99) for r in P.percentiles(df, {"g": ["g"]}, "x").collect()}
    assert got == {"2": (3, 0.0, float("inf"))}
    assert P.percentiles(df.limit(0), {"g": ["g"]}, "x").count() == 0 and P.summaries(df.limit(0), ["g"], "x").count() == 0


def test_kept_summaries_combine(spark):
    rng = random.Random(8)
    rows = [(d, g, int(rng.lognormvariate(4 + d / 5, 1.5))) for d in range(12) for g in "ab" for _ in range(rng.choice([1, 40, 900]))]
    df = spark.createDataFrame(rows, "day int, g string, x int")
    kept = P.summaries(df, ["day", "g"], "x", parts=20)
    for by in (["g"], []):
        for r in P.combine(kept, by).collect():
            xs = sorted(x for _, g, x in rows if not by or g == r.g)
            assert r.n == len(xs) and r.rank_error <= len(xs) / 20 + 12 * 2
            for p in (50, 90, 95, 99):
                t, v = P.rank_of(p, len(xs)), r[f"p{p}"]
                assert bisect.bisect_left(xs, v) + 1 - r.rank_error <= t <= bisect.bisect_right(xs, v) + r.rank_error
    assert P.combine(kept.limit(0), ["g"]).count() == 0 and P.combine(kept.limit(0)).count() == 0


# Places

REF = [(1, "Mount Oakton", "NJ", "New Jersey", "07001", "07049"), (2, "Fennburg", "VT", "Vermont", "05001", "05010"), (3, "Fennburg", "TX", "Texas", "75001", "75009"), (4, "Fennburg Heights", "TX", "Texas", "75101", "75109"), (5, "Río Claro", "PR", "Puerto Rico", "00601", "00699")]
PLACES = [
    ("Mount Oakton", "NJ", "07002", 1), ("Mt. Oakton", "NJ", "", 1), ("City of Mount Oakton", None, None, 1), ("Mount Oakton City Limits", "Texas", "75001", 1),
    ("mont oaktn", "nj", "07002", 1), ("Fennburg", "Verm.", "", 2), ("Fennburg", "", "75003", 3), ("Fennburg", "VT", "75003", 3), ("Fennburg Hts", "TX", "75001", 4),
    ("Fenburg Hts.", "TX", "", 4), ("Rio Claro", "P.R.", "601", 5), ("Fnnbrg", "VT", "05001", 2), ("NJ", "Mount Oakton", "07001", 1), ("Fennburg VT 05001", "", "", 2),
    ("Quibbleton", "NJ", "07001", -1), ("unknown", "NJ", "07001", 1), ("", "", "O7001", 1), (None, None, None, -1), ("N/A", "n/a", "n/a", -1), ("", "TX", "", -1), ("", "VT", "", 2), ("x" * 20_000, "NJ", "07001", -1),
]


@pytest.mark.parametrize("city,state,zip_,want", PLACES)
def test_places(city, state, zip_, want):
    assert Gazetteer(REF).find(city, state, zip_)[0] == want


def test_place_parts():
    assert [clean_zip(z) for z in ("07001", "7001", "O7OOl", "07001-1234", "070011234", "07001.0", "070 01", "070", "n/a", None, "0700123")] == ["07001", "07001", "07001", "07001", "07001", "07001", "07001", "070", "", "", ""]
    assert edits("ab", "ba") == 1 and edits("abc", "") == 3 and edits("kitten", "sitting") == 3


def test_map_places(spark):
    rows = [(i, c, s, z) for i, (c, s, z, _) in enumerate(PLACES)] + [(0, *PLACES[0][:3]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, city string, state string, zip string").withColumns({"k": F.lit(1), "c": F.lit(1), "fits": F.lit(1), "score": F.lit(1)})
    ref = spark.createDataFrame(REF, "city_ref_id bigint, city string, state string, state_name string, zip_low string, zip_high string")
    got = map_places(df, ref).collect()
    assert len(got) == len(rows) and all(r.city_ref_id == PLACES[r.id][3] for r in got if r.id is not None)
    assert [r.fits for r in got if r.id == 0] == [True, True]
    assert map_places(df.limit(0), ref).count() == 0 and {r.city_ref_id for r in map_places(df, ref.limit(0)).collect()} == {-1}


# Same address

SAME = [
    {"12 N Oak Hollow Street Apt 4|Mount Oakton|NJ|07001", "12 north oak hollow st. #4|Mt Oakton|NJ|", "Apt 4, 12 N. OakHollow St|Mount Oakton|NJ|07001", "12 Oak-Hollow St N Unit 4|Mount Oakton|new jersey|07001"},
    {"12 N Oak Hollow Street Apt 5|Mount Oakton|NJ|07001", "> 07001 Mount Oakton, NJ, 12 N Oak Hollw St, Apt 5"},
    {"12 S Oak Hollow Street Apt 4|Mount Oakton|NJ|07001", "> 12 South Oak Hollow Str Apt4; Mount Oakton; NJ 07001"},
    {"14 N Oak Hollow Street Apt 4|Mount Oakton|NJ|07001"},
    {"12 N Oak Hollow Ave Apt 4|Mount Oakton|NJ|07001"},
    {"12 N Oak Hollow Street Apt 4|Fennburg|VT|05001", "> 12 N Oak Hollow Street Apt 4 Fennburg VT 05001"},
    {"PO Box 77|Fennburg|VT|05001", "> p.o. box 77, Fennburg, Vermont 05001, USA", "> Post Office Box 77 | Fenburg | VT"},
    {"Urb Las Flores, 8 Calle Sol|Río Claro|PR|00601", "> 8 C/ Sol, Urbanizacion Las Flores - Rio Claro - PR 00601"},
    {"Urb El Monte, 8 Calle Sol|Río Claro|PR|00601"},
    {"88 Pine Marsh Trl|Quibbleton|NJ|07999", "> Quibbleton NJ, 88 Pine Marsh Trail, 07999", "> 88 Pine Marsh, Quibleton, NJ 07999"},
    {"7 Elm Glen Ct|Fennburg|TX|75001", "> 7 Elm Glen, Fennburg, TX 75001", "> 7 Elm Glen Ct, TX 75001", "> Elm Glen Ct, Fennburg, TX 75001"},
]


def address_tables(spark):
    v, f, want, n = [], [], set(), 0
    for group in SAME:
        ids = []
        for text in sorted(group):
            n += 1
            ids.append(n)
            if text.startswith("> "):
                f.append((n, text[2:]))
            else:
                v.append((n, *text.split("|"), None))
        want |= {(a, b) for a in ids for b in ids if a < b}
    v.append((900, "9 wrong", "x", "x", "x", "7 Elm Glen Ct"))
    v[-1] = (900, "9 wrong st", "Fennburg", "TX", "75001", "7 Elm Glen Ct")
    want |= {(i, 900) for i in range(n - 3, n + 1)}
    v += [(901, None, None, None, None, None), (902, "", "", "", "", ""), (None, "12 N Oak Hollow Street Apt 4", "Mount Oakton", "NJ", "07001", None), v[0]]
    f += [(903, None), (904, ""), (905, "?" * 5000), (906, "a b c " * 3000)]
    cols = "id bigint, address string, city string, state string, zip string, correct_address string"
    va = spark.createDataFrame(v, cols).withColumns({c: F.lit(None).cast("string") for c in ("correct_street", "correct_city", "correct_state", "correct_zip")} | {"line": F.lit(1), "whole": F.lit(1), "name": F.lit(1)})
    ref = spark.createDataFrame(REF, "city_ref_id bigint, city string, state string, state_name string, zip_low string, zip_high string")
    return va, spark.createDataFrame(f, "id bigint, input string").withColumn("sig", F.lit(1)), ref, want


def test_same_address(spark):
    v, f, ref, want = address_tables(spark)
    assert {tuple(r) for r in same_address_pairs(v, f, ref).collect()} == want


def pairs_of(spark, typed):
    """Pairs found among (id, address, city, state, zip)."""
    v, f, ref, _ = address_tables(spark)
    rows = spark.createDataFrame([(*t, None) for t in typed], "id bigint, address string, city string, state string, zip string, correct_address string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("correct_street", "correct_city", "correct_state", "correct_zip")})
    return {tuple(r) for r in same_address_pairs(rows, f.limit(0), ref).collect()}


def test_boxes_settled_and_looked_up(spark):
    typed = [
        (1, "PO Box 12", "Yssing Fork", "TX", ""), (2, "PO Box 12", "Yssinf Fork", "TX", ""), (3, "PO Box 12", "Yssing Fork", "", ""), (4, "PO Box 12", "", "", ""),
        (5, "PO Box 13", "Yssing Fork", "TX", ""), (6, "PO Box 13", "Yssing Fork", "NJ", ""), (7, "PO Box 13", "Yssing Fork", "", ""), (8, "PO Box 13", "", "TX", ""),
        (9, "PO Box 14", "Fennburg", "VT", "05001"), (10, "PO Box 14", "", "", ""),
    ]
    assert pairs_of(spark, typed) == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b} | {(5, 8), (9, 10)}


def test_records_without_a_street(spark):
    typed = [
        (1, "31 Elm Glen Ct Apt 4", "Fennburg", "VT", "05001"), (2, "31 Apt 4", "Fennburg", "VT", "05001"),
        (3, "32 Elm Glen Ct", "Fennburg", "VT", "05001"), (4, "32 Pine Marsh Trl", "Fennburg", "VT", "05001"), (5, "32", "Fennburg", "VT", "05001"),
    ]
    assert pairs_of(spark, typed) == {(1, 2)}


def doors_of(spark, rows):
    """Written doors of (place, number, name, type, town), each of one record."""
    cols = "place string, number string, name array<string>, type string, town string"
    return spark.createDataFrame(rows, cols).withColumns({"n": F.lit(1), "direction": F.lit(""), "state": F.lit("nj"), "box": F.lit(""), "sig": F.expr("uuid()")})


def mined(spark, rows):
    return {(r.old, r.new): r.support for r in mine_rewrites(doors_of(spark, rows)).collect() if r.ratio > SIGNIFICANT}


def test_mines_slips_of_a_second_street(spark):
    doors = [("1", n, ["brackworth"]) for n in range(60)] + [("1", n, ["stavmead"]) for n in range(12)] + [("1", n, ["stavmeab"]) for n in range(3)] + [("2", n, ["larkspur"]) for n in range(200)]
    assert mined(spark, [(p, str(n), name, "", "") for p, n, name in doors]) == {("stavmeab", "stavmead"): 3}


def test_mines_types_towns_and_words_apart(spark):
    doors = [("1", str(n), ["oak", "hollow"], "st", "") for n in range(40)] + [("1", str(n), ["oakhollow"], "st", "") for n in range(5)]
    doors += [("1", str(n), ["oak", "hollow", "streat"], "", "") for n in range(4)] + [("1", str(n), ["elm"], "ave", "") for n in range(300)]
    doors += [("?quibbleton", str(n), ["pine"], "rd", "quibbleton") for n in range(30)] + [("?quibleton", str(n), ["pine"], "rd", "quibleton") for n in range(2)]
    got = mined(spark, doors)
    assert got["oakhollow", "oak hollow"] == 5 and got["streat", "street"] == 4 and got["@quibleton", "@quibbleton"] == 2 and len(got) == 3
    out = rewrite(doors_of(spark, doors), spark.createDataFrame([(*k, 1) for k in got], "old string, new string, support int"))
    assert {(r.place, tuple(r.name), r.type) for r in out.collect()} == {("1", ("oak", "hollow"), "st"), ("1", ("elm",), "ave"), ("?quibbleton", ("pine",), "rd")}


def test_does_not_mine_real_neighbours_or_chance(spark):
    doors = [("1", str(n), [w], "st", "") for n in range(80) for w in ("mallow", "mellow")] + [("1", "900", ["willow"], "st", "")]
    assert mined(spark, doors) == {}


def test_respells_words_without_company(spark):
    doors = [("1", str(n), ["viaduct"], "st", "") for n in range(12)] + [("1", str(n), ["mallow"], "st", "") for n in range(12)] + [("1", str(n), ["mellow"], "st", "") for n in range(12)]
    doors += [("2", "900", ["vidct"], "st", ""), ("2", "901", ["viadukt"], "st", ""), ("2", "902", ["millow"], "st", ""), ("2", "903", ["quay"], "st", "")]
    assert {(r.old, r.new) for r in respellings(doors_of(spark, doors)).collect()} == {("vidct", "viaduct"), ("viadukt", "viaduct")}


def brute_locations(doors):
    """Locations of whole doors in listed places, by comparing all of one place and number: equal parts, or left out where one fits."""
    made = {}
    for d in doors:
        same = [x for x in doors if x["place"] == d["place"] and x["number"] == d["number"] and x["name"] == d["name"]]
        for part in ("direction", "type"):
            d = d if d[part] or len({x[part] for x in same} - {""}) != 1 else {**d, part: ({x[part] for x in same} - {""}).pop()}
        units = {x["unit"] for x in same}
        made[d["sig"]] = (d["place"], d["number"], d["name"], d["direction"], d["type"], d["unit"] if d["unit"] or len(units) != 2 else max(units))
    return made


def test_settle_against_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        doors = [{"sig": i, "place": "1", "number": str(rng.randint(1, 3)), "name": (rng.choice("ab"),), "direction": rng.choice(["", "n"]), "type": rng.choice(["", "st"]), "unit": rng.choice(["", "4"]), "urb": "", "state": "", "n": 1} for i in range(9)]
        want = brute_locations([dict(d) for d in doors])
        got = {}
        for number in "123":
            some = [dict(d) for d in doors if d["number"] == number]
            settle(some)
            got |= {d["sig"]: (d["place"], d["number"], d["name"], d["direction"], d["type"], d["unit"]) for d in some}
        assert got == want


def test_same_address_empty(spark):
    v, f, ref, _ = address_tables(spark)
    assert same_address_pairs(v.limit(0), f.limit(0), ref).count() == 0


def test_parser():
    p = Parser(Gazetteer(REF))
    a = p.parse("Lantern Plaza, 12 S.W. Oak Hollow Blvd., Ste. 14A", "Fennburg", "TX", "75001")
    assert (a["number"], a["direction"], a["name"], a["type"], a["unit"], a["city"]) == ("12", "sw", ["oak", "hollow"], "blvd", "14A", 3)
    b = p.parse("12 SW Oak Hollow Boulevard Suite 14A Fennburg TX 75001", whole=True)
    assert all(a[k] == b[k] for k in ("number", "direction", "name", "type", "unit", "city"))


def test_settle_keeps_ambiguous_apart():
    door = lambda **k: {"number": "1", "direction": "", "type": "st", "unit": "", "urb": "", "state": "", "place": "1", "n": 1, "name": ["oak"], **k}
    d = [door(direction="n"), door(direction="s"), door()]
    settle(d)
    assert [x["direction"] for x in d] == ["n", "s", ""]
    d = [door(direction="n"), door(), door(type="")]
    settle(d)
    assert {(x["direction"], x["type"]) for x in d} == {("n", "st")}
    d = [door(unit="1"), door(unit="2"), door()]
    settle(d)
    assert [x["unit"] for x in d] == ["1", "2", ""]
    d = [door(name=["oak", "trail"]), door(type="trl")]
    settle(d)
    assert {(x["name"], x["type"]) for x in d} == {(("oak", "trail"), "st")}


# Text types

COMMON = frozenset("the of and to in a is that it was for on are with as at be this have from not but what all we when there if will would so no la de que el en y los se una es".split())
PROSE = "We asked the clerk to look at the letter again and it was not in the box. There is no reply so far, but we will ask when the office is open."
KINDS = [
    (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.replace(".", "").replace(",", "").lower(), "prose"), ("\n".join(f"A: {s}." for s in PROSE.split(".") if s) * 3, "prose"),
    ("La carta se quedó en la casa de los vecinos y no es de ellos. El cliente no quiere que la casa se venda en la plaza.", "prose"),
    ("Bevi tazula mipo sarelona. Kufi da belomari zanu? Tisopa ruvela bo minatu sefo karila. Dofe paluri zeka nimo.", "junk"),
    ("Der Bote hat den Brief gestern wieder in das falsche Haus gebracht. Wir fragten deshalb bei der Stadt nach. Niemand wusste etwas davon, obwohl das Schild an der Ecke steht.", "prose"),
    (PROSE + "\n\n- one thing\n- another thing\n\n" + PROSE, "prose"),
    ("\n".join(f"- check ledger {i}" for i in range(12)), "list"), ("\n".join(f"{i}. {w} Harbor" for i, w in enumerate("Oak Elm Pine Ash Birch Cedar Larch".split())), "list"),
    (" / ".join(f"{i} Harbor Mill Ln" for i in range(15)), "list"), ("\n".join(f"Unit: stale form {i}" for i in range(9)), "list"), ("\n".join(f"{i}7 Amber Knoll Dr" for i in range(9)), "list"),
    ("id,city,zip,ms,score\n" + "\n".join(f"{i},Fennburg,0{i}001,{i * 7},0.{i}" for i in range(9)), "table"),
    ("| a | b | c | d |\n| --- | --- | --- | --- |\n" + "\n".join(f"| {i} | x{i} | {i * 3} | Oakton |" for i in range(9)), "table"),
    ("zip    ms    city      unit\n-----  ----  --------  ----\n" + "\n".join(f"0700{i}  {i}00  Oakton    {i}B" for i in range(9)), "table"),
    ("lorem " * 60, "junk"), ("N/A\n" * 80, "junk"), ("#@!$%^&*" * 30, "junk"), (base64.b64encode(bytes(range(256)) * 3).decode(), "junk"),
    ("qwdf lkxzj sdfkjq wpeorx zxcvkl qwrtpl sdfghj klzxcv " * 8, "junk"), ("Ã©tÃ© Ã  lâ€™Ã©cole Ã±Â Ð¡Ñ‚ " * 20, "junk"), ("\n".join(f"{i:06x}  " + " ".join(f"{(i * 37 + j * 91) % 256:02x}" for j in range(16)) for i in range(12)), "junk"),
]


def test_text_types(spark):
    rows = [(i, t) for i, (t, _) in enumerate(KINDS)] + [(1000 + i, f"{PROSE} Line {i} of the file is not there.") for i in range(60)] + [(2000, None), (2001, ""), (2002, " \n\t "), (0, KINDS[0][0]), (None, PROSE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"k": F.lit(1), "t": F.lit(1), "votes": F.lit(1), "kind": F.lit(1)})
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    got = text_types(df, words).collect()
    kinds = {r.doc_id: r.kind for r in got}
    assert len(got) == len(rows) and [(i, kinds[i], k) for i, (_, k) in enumerate(KINDS) if kinds[i] != k] == []
    assert kinds[2000] is kinds[2001] is kinds[2002] is None and kinds[1000] == "prose"
    s = {r.doc_id: r for r in statistics(df, words).collect()}
    assert s[2000].n_words is None and s[2001].n_words == 0 and s[2002].symbol_ratio == 0.0
    assert text_types(df.limit(0), words).count() == 0


def test_statistics_of_very_long_texts():
    for text in ("a" * 300_000, "a " * 150_000, "\n" * 100_000 + "x", "- x\n" * 50_000, ",;|\t" * 30_000):
        assert describe(text, COMMON)["words"] >= 1


def test_statistics_of_wordy_rows():
    common = frozenset({"the", "of"})
    row = "\t".join(f"the {a} of the {b}" for a, b in (("clerk", "town"), ("office", "river"), ("letter", "north"), ("street", "gate")))
    s = describe("\n".join([row] * 3 + [row.replace("clerk", "warden")] * 3), common)
    assert s["per_line"] > 12 and s["common"] >= 0.25 and s["grid"] == s["fields"] == 1.0
    s = describe("\n".join(f"- the clerk of the office sent {w} letter of the town to the gate of the river" for w in ("one", "this", "that", "every")), common)
    assert s["per_line"] > 12 and s["common"] >= 0.25 and s["items"] == 1.0 and s["run"] > 0


def test_statistics_of_long_words_and_prose_commas():
    assert describe("bcdfg" * 20 + " " + "strength " * 3, COMMON)["clusters"] == 0.25
    assert describe("bcdfga" * 50_000, COMMON)["clusters"] == 1.0
    prose = "\n".join(f"At noon, as the clerk of office {i} had said, the letter came back, with a note, to the town." for i in range(6))
    assert describe(prose, COMMON)["grid"] == describe(prose, COMMON)["fields"] == 0.0
    rows = "\n".join(f"{i}, North Gate, 0700{i}, open; late" for i in range(6))
    assert describe(rows, COMMON)["grid"] == 1.0


def test_learning_matters(spark, tables):
    """The rates learned differ from the start, and some texts come out otherwise by them."""
    common = frozenset(r.word.lower() for r in spark.read.parquet(f"{tables}/common_words.parquet").collect())
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect() if r.text and r.text.strip()]
    on = np.array([[f(s) for _, _, f in FUNCTIONS] for s in (describe(t, common) for t in texts)], float)
    pats, counts = np.unique(on, axis=0, return_counts=True)
    start = start_rates()
    prior, rate = learn(pats, counts.astype(float), start)
    kinds = [(np.log(p) + on @ np.log(r).T + (1 - on) @ np.log(1 - r).T).argmax(1) for p, r in ((np.full(4, 0.25), start), (prior, rate))]
    assert (kinds[0] != kinds[1]).any()
    name = [n for n, _, _ in FUNCTIONS].index
    assert rate[TYPES.index("prose"), name("few_common")] < 0.1 and rate[TYPES.index("list"), name("few_common")] > 0.7


def test_learned_accuracies():
    rng = np.random.default_rng(1)
    votes = np.array([0, 0, 1, 1, 2, 2, 3, 3])
    truth = rng.choice(4, 4000, p=[0.7, 0.1, 0.1, 0.1])
    fires = np.where(votes[None, :] == truth[:, None], rng.random((4000, 8)) < [0.9, 0.6] * 4, rng.random((4000, 8)) < 0.03).astype(float)
    pats, counts = np.unique(fires, axis=0, return_counts=True)
    prior, rate = learn(pats, counts.astype(float), np.where(votes[None, :] == np.arange(4)[:, None], 0.5, 0.02))
    assert abs(prior[0] - 0.7) < 0.03 and abs(rate[0, 0] - 0.9) < 0.05 and abs(rate[1, 3] - 0.6) < 0.1
    assert len(FUNCTIONS) < 24 and len(TYPES) == 4
