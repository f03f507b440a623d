"""Edge cases of the core's operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators import addresses as A
from wayfold.operators import customers as C
from wayfold.operators import documents as D
from wayfold.operators import language as L
from wayfold.operators import records as R
from wayfold.operators import telemetry as M
from wayfold.operators import vectors as V
from wayfold.plans.tools import Tool, standard


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("CRID-000001", "Ann Able", "12 Oak St Apt 4", "Oakton", "NJ", "ACTIVE", "RESIDENTIAL", 3),
        ("CRID-000002", "Anna Bell", "9 Elm Ave", "Elm Gate", "VT", "INACTIVE", "BUSINESS", 0),
        ("CRID-000003", None, None, None, None, None, None, None),
        ("CRID-12", "Bob 100%", "1_A St", "Oakton", "nj", "active", "RESIDENTIAL", 5),
    ]
    df = spark.createDataFrame(rows, "crid string, name string, address string, city string, state string, status string, customer_type string, move_count int")
    return df.withColumn("move_history", F.lit(None).cast("array<struct<from_address:string,to_address:string,city:string,state:string,zip:string,move_date:date>>"))


def ids(df):
    return sorted(r.crid for r in df.collect())


def test_lookup(people):
    assert C.crid_candidates("crid-7") == ["CRID-000007", "CRID-007", "CRID-7"]
    assert C.crid_candidates("x") == ["X"]
    assert ids(C.lookup(people, "crid-1")) == ["CRID-000001"]
    assert ids(C.lookup(people, "CRID-12")) == ["CRID-12"]
    assert ids(C.lookup(people, "nobody")) == []


def test_search(people):
    assert ids(C.search(people, state="nj", status="ACTIVE")) == ["CRID-000001", "CRID-12"]
    assert ids(C.search(people, city="GATE")) == ["CRID-000002"]
    assert ids(C.search(people, has_apartment=True)) == ["CRID-000001"]
    assert [r.total for r in C.search(people, limit=1).collect()] == [4]
    assert ids(C.search(people, city="%")) == []


def test_criteria(people):
    ne = [{"field": "status", "operator": "not_equals", "value": "active"}]
    assert ids(C.multi_search(people, ne)) == ["CRID-000002"]  # null is not unequal
    assert ids(C.multi_search(people, [{"field": "name", "operator": "contains", "value": "100%"}])) == ["CRID-12"]
    assert ids(C.multi_search(people, [])) == ids(people)
    assert C.multi_search(people, [{"field": "name", "operator": "?", "value": 1}]).count() == 0
    with pytest.raises(ValueError):
        C.range_search(people, "name", 1, 2)
    assert {r.value: r.n for r in C.group_by(people, "status").collect()}["UNKNOWN"] == 1


def test_similar_names(people):
    got = {r.name: r.score for r in C.similar_names(people, "Ann").collect()}
    assert got["Ann Able"] == 1.0 and got["Anna Bell"] == 0.95
    assert C.autocomplete_fuzzy(people, "name", "an").count() == 2


def test_upsert_and_delta(spark):
    t, c = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in C.upsert(t, c, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in C.delta(c, t, "k").collect()) == [(1, "remove"), (3, "add")]


def test_soundex_and_sounds(spark):
    df = spark.createDataFrame([("Bob",), ("",), ("123",), ("Smith",), ("Smyth",), ("Ashcraft",), ("Knight",)], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", X.soundex_code(F.col("s")).alias("a"), X.sound_code(F.col("s")).alias("b")).collect()}
    assert got["Bob"][0] == "B000" and got[""][0] == got["123"][0] == "0000" and got["Smith"][0] == got["Smyth"][0]
    assert got["Smith"][0] == A._soundex("Smith") and got["Ashcraft"][0] == A._soundex("Ashcraft")
    assert got["Knight"][1] == A._sounds("Knight") == "NT" and got["Smith"][1] == A._sounds("Smith")


def test_text(spark):
    df = spark.createDataFrame([("Call 555-12-3456 or a@b.co",), (None,)], "s string")
    clean, counts = X.redact(F.col("s"))
    assert [tuple(r) for r in df.select(clean, counts["ssn"]).collect()] == [("Call [REDACTED-SSN] or [REDACTED-EMAIL]", 1), (None, None)]
    one = spark.range(1)
    assert one.select(X.levenshtein_similarity(F.lit(""), F.lit(""))).first()[0] == 1.0
    assert one.select(X.levenshtein_similarity(F.lit("ab"), F.lit(""))).first()[0] == 0.0
    assert one.select(X.refusal(F.lit("my SSN please"))).first()[0] == "pii"


def test_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(base)), (2, " ".join(reversed(base))), (3, " ".join([*base[:98], "x", "y"])), (4, " ".join(base[:50])), (5, None), (6, ""), (7, " ".join([*base, "z"]))]
    got = {r.doc_id: (r.class_id, r.links) for r in D.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (4, 0), 7: (7, 2)}
    j = lambda a, b: len(a & b) / len(a | b)
    sets = {i: set(t.split()) for i, t in docs if t}
    assert got[3][1] == sum(j(sets[3], sets[i]) >= 0.95 for i in (1, 4, 7))


def test_near_copies_move_little(spark):
    """candidates carried their words, so that texts of common words took a multiple of the input; all pairs are still found."""
    rng = random.Random(7)
    vocabulary = [f"{k}word" for k in range(98)] + ["ÉTÉ", "naïve"]
    docs = [(i, rng.sample(vocabulary, 60)) for i in range(400)]
    for i in range(400, 520):  # copies: fewer words, more, others; some at the limit, 19 of 20 and 38 of 40
        at = sorted(rng.sample(docs[i - 400][1], rng.choice([19, 20, 39, 60])))
        docs += [(i, at), (i + 1000, at[:-1]), (i + 2000, [*at, "more"]), (i + 3000, [*at[1:], "other"]), (i + 4000, [*at[2:], "a", "b"]), (i + 5000, at[::-1])]
    rows = [(i, rng.choice([" ", "\n", " \t\x0b"]).join(["", *ws, rng.choice(ws).upper()])) for i, ws in docs] + [(9000, ""), (9001, " \n"), (9002, None), (9003, "x\u00a0y"), (9004, "x y")]
    df = spark.createDataFrame([*rows, rows[0], rows[400]], "doc_id bigint, text string").coalesce(2)
    seen = {s.stageId() for s in _stages(spark)}
    got = {r.doc_id: (r.class_id, r.links) for r in D.near_copies(df).collect()}
    moved = sum(s.shuffleWriteBytes() for s in _stages(spark) if s.stageId() not in seen)
    classes: dict[frozenset, int] = {}
    sets = {i: frozenset(t.lower().split(" ") if i == 9003 else t.lower().split()) for i, t in rows if t and t.strip()}
    for i, s in sorted(sets.items()):
        classes.setdefault(s, i)
    links = dict.fromkeys(classes, 0)
    for a, b in itertools.combinations(classes, 2):
        if len(a & b) / len(a | b) >= 0.95:
            links[a] += 1
            links[b] += 1
    assert got == {i: (classes[s], links[s]) for i, s in sets.items()} and sum(links.values()) > 400
    assert moved < 3 * sum(len(t) for _, t in rows if t)
    with pytest.raises(ValueError):
        D.near_copies(df, 0)


def _stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def test_chunk_words(spark):
    df = spark.createDataFrame([(1, "a b c\n\nd e f g h\n\ni"), (2, None), (3, ""), (4, "x " * 50)], "doc_id bigint, text string")
    got = D.chunk_words(df, 5).collect()
    assert {r.doc_id for r in got} == {1, 4} and all(r.words <= 5 for r in got)
    assert {w for r in got if r.doc_id == 1 for w in r.chunk.split()} == set("abcdefghi")


def test_telemetry(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(minutes=m)) for m in (0, 10, 45, 46, 400, 1000)] + [("s", t0), (None, t0), ("r", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = sorted((r.session_no, r.events) for r in M.sessions(df, "k", "ts", 1800, 3600).collect())
    assert got == [(1, 3), (2, 2), (3, 1), (4, 1)]
    v = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", None)], "g string, v int")
    assert [tuple(r) for r in M.ranked(v, ["g"], "v", [50, 99]).collect()] == [("a", 4, 3, 4)]
    assert M.sessions(df.limit(0), "k", "ts", 1800).count() == 0


def test_parse_and_classify(spark):
    rows = [(1, "12 N Oak Street Apt. 4", "Oakton", "new jersey", "07001-1234"), (2, "Urb. Las Flores, 7 Calle Sol", "Ponce", "PR", "00715"), (3, None, None, None, None), (4, "Oak", "", "ZZ", "1")]
    p = A.parse(spark.createDataFrame(rows, "id int, address string, city string, state string, zip string"))
    r = {x.id: x for x in A.classify(p).collect()}
    assert (r[1].number, r[1].direction, r[1].name, r[1].type, r[1].unit, r[1].code, r[1].zip5) == ("12", "N", "oak", "ST", "4", "NJ", "07001")
    assert r[2].urbanization == "las flores" and r[2].is_pr and not r[1].is_pr
    assert r[1].quality == "complete" and r[3].quality == r[4].quality == "invalid"


def test_similarity():
    a = {"number": "12", "name": "oak", "place": "oakton", "code": "NJ", "zip5": "07001"}
    assert A.address_similarity(a, a)["overall"] == pytest.approx(1.0)
    assert A.address_similarity(a, {**a, "zip5": "07010"})["zip"] == 0.8
    assert A.address_similarity(a, {})["overall"] == 0.0
    assert 0 <= A.best_match("smith", "smyth", 0.7) < 1 and A.best_match(None, "x", 0.7) == 0.0


def test_fuzzy_matches(spark):
    rows = [(1, "12 Oak St", "Oakton", "NJ", "07001"), (2, "12 Oka St", "Oakton", "NJ", "07001"), (3, "13 Oak St", "Oakton", "NJ", "07001")]
    p = A.parse(spark.createDataFrame(rows, "id int, address string, city string, state string, zip string"))
    got = {(r.p_id, r.i_id): r.score for r in A.fuzzy_matches(p, p, "id", "id").where("p_id <> i_id").collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2] > 0.8


def test_fuzzy_matches_of_other_and_no_numbers(spark):
    rows = [(1, "1234 Main St", "Oakton", "NJ", "07001"), (2, "1243 Main St", "Oakton", "NJ", "07001"), (3, "Main St", "Oakton", "NJ", "07001"), (4, "1234 Main St", "Oakton", "NJ", None), (5, "9 Elm Ave", "Fennburg", "VT", "05001"), (6, "1234 Main St", "Fennburg", "VT", "05002")]
    p = A.parse(spark.createDataFrame(rows, "id int, address string, city string, state string, zip string"))
    got = {(r.p_id, r.i_id): r for r in A.fuzzy_matches(p, p, "id", "id", same_number=False).where("p_id <> i_id").collect()}
    near = {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a != b}
    assert near <= set(got) and not any(5 in k for k in got)
    assert got[1, 2].match_type == "fuzzy_zip" and got[4, 1].match_type == "fuzzy_city" and got[1, 4].match_type == "fuzzy_street"
    parts = {r.id: r.asDict() for r in p.collect()}
    assert all(r.score == pytest.approx(A.address_similarity(parts[a], parts[b])["overall"], abs=1e-6) for (a, b), r in got.items())


def test_verify_without_a_number(spark, monkeypatch):
    from wayfold.plans import addresses as Q

    rows = [(1, "Main St", "Oakton", "NJ", "07001", None), (2, "Main St", "Oakton", "NJ", "07001", None)]
    t = spark.createDataFrame(rows, "id int, address string, city string, state string, zip string, error_type string")
    monkeypatch.setattr(Q, "table", lambda *_: t)
    assert {(r.id, r.score, r.status) for r in Q.QUERIES["addr_verify"](spark, "").collect()} == {(1, 1.0, "verified"), (2, 1.0, "verified")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 3), (5, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert [r.vec_id for r in V.nearest(df, [1.0, 0.0], 2).collect()] == [1, 3]
    got = {(r.query_id, r.vec_id): r.rank for r in V.nearest_of_many(df, df.where("vec_id = 1"), 2).collect()}
    assert got == {(1, 3): 1, (1, 2): 2}
    assert V.nearest_of_many(df, df.limit(0), 2).count() == 0
    ok = {r.vec_id: r.ok for r in df.select("vec_id", V.valid(F.col("embedding"), 2).alias("ok")).collect()}
    assert ok == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    want = sorted(map(tuple, V.nearest_of_many(df, df.where("vec_id % 2 = 0"), 3).collect()))
    monkeypatch.setattr(V, "MOST_QUERIES", 4)
    got = V.nearest_of_many(df, df.where("vec_id % 2 = 0"), 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 60
    assert got.columns == ["query_id", "vec_id", "label", "score", "rank"]


def test_language(spark, people):
    q = ["customers in TX", "west virginia people", "who moved from Ohio to Texas", "crid-17", "how many inactive in Flordia", "high movers", "show 500 customers", "stay in OR", None, ""]
    df = spark.createDataFrame([(x,) for x in q], "q string")
    r = {x.q: x for x in L.parsed(df, "q").collect()}
    assert r["customers in TX"].state == "TX" and r["west virginia people"].state == "WV" and r["stay in OR"].state == "OR"
    assert r["who moved from Ohio to Texas"].origin == "ohio" and r["crid-17"].crid == "CRID-000017"
    assert r["how many inactive in Flordia"].status == "INACTIVE" and r["how many inactive in Flordia"].state == "FL"
    assert r["high movers"].min_moves == 5 and r["show 500 customers"].row_limit == 100 and r[None].state is None
    assert ids(L.answer(people, "find crid-1")) == ["CRID-000001"]


def test_records(spark):
    df = spark.createDataFrame([(" a ", "N/A", "x"), ("null", None, "")], "` Name ` string, `Zip Code` string, zip_code string")
    c = R.cleaned(df)
    assert c.columns == ["name", "zip_code", "zip_code_2"]
    assert [tuple(r) for r in c.collect()] == [("a", None, "x"), (None, None, None)]
    n = spark.createDataFrame([Row(a=1, b=Row(c=Row(d=Row(e=5))), l=[1], m=[])], "a int, b struct<c:struct<d:struct<e:int>>>, l array<int>, m array<int>")
    assert R.flattened(n).first().asDict() == {"a": 1, "b_c_d": '{"e":5}', "l": "[1]", "m": None}
    assert R.detect_mapping(["Addr1", "town", "st", "postcode", "x"]) == {"street": "Addr1", "city": "town", "state": "st", "zip": "postcode"}
    assert R.mapping_confidence({"city": "x"}) == 0.2125
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, 0.3)], "k string, o int, c double")
    assert {r.k: r.confidence for r in R.folded_confidence(s, "k", "o", [], "c").collect()} == {"a": 0.75, "b": 0.3}
    i = R.indexed(spark.range(100).select(F.col("id")), ["id"]).collect()
    assert sorted((r.row_no, r.id) for r in i) == [(k + 1, k) for k in range(100)]
    assert R.indexed(spark.range(0).select("id"), ["id"]).count() == 0


def test_tools(people):
    r = standard()
    assert len(r.tools) == 19 and r.available("ask") and "get_stats" in r.for_intent("stats")
    assert ids(r.execute("filter_by_status", people, {"status": "active"})) == ["CRID-000001", "CRID-12"]
    assert r.execute("count_by_criteria", people, {"state": "NJ"}).first()[0] == 2
    for bad in ({}, {"status": 1}, {"status": "x", "nope": 1}):
        with pytest.raises(ValueError):
            r.execute("filter_by_status", people, bad)
    with pytest.raises(KeyError):
        r.execute("none", people)
    with pytest.raises(ValueError):
        r.register(Tool("ask", None))


# Beyond the size at which an operator works in parts


def test_adjacent_over_ranges(spark):
    rows = [("hot", i * 3) for i in range(200)] + [("b", 7), (None, 5), (None, 8)]
    got = {(r.f, r.i): (r.before, r.after) for r in D.adjacent(spark.createDataFrame(rows, "f string, i bigint"), "f", "i", width=50).collect()}
    assert len(got) == 203 - 2 and all(got["hot", i * 3] == ((i - 1) * 3 if i else None, (i + 1) * 3 if i < 199 else None) for i in range(200))
    assert got["b", 7] == (None, None)
    assert D.adjacent(spark.createDataFrame([], "f string, i bigint"), "f", "i").count() == 0


def test_stratified_is_one_definition(spark):
    rows = [("hot" if i % 3 else None, i) for i in range(900)] + [("rare", 5000)]
    df = spark.createDataFrame(rows, "s string, i bigint")
    got = {(r.s, r.i) for r in D.stratified(df, "s", "i", 100).collect()}
    want = {(s, i) for s in ("hot", None, "rare") for n, i in enumerate(sorted(i for x, i in rows if x == s)) if n % 9 == 0}
    assert got == want and D.stratified(df.limit(0), "s", "i", 100).count() == 0
    numbered = {(r.s, r.i): r.row_no for r in R.indexed(df, ["i"], by=["s"]).collect()}
    assert numbered["hot", 1] == 1 and numbered[None, 897] == 300 and numbered["rare", 5000] == 1


def test_folded_over_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [("k", i, rng.random()) for i in range(60)] + [("one", 9, 0.4), ("k", 3, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, c double").withColumn("o", F.lit(1))
    acc = None
    for _, _, c in rows[:60]:
        acc = c if acc is None else min(1.0, acc * 0.6 + c * 0.5)
    for width in (7, 100_000):
        got = {r.k: (r.n, r.confidence) for r in R.folded_confidence(df, "k", "i", ["o"], "c", width).collect()}
        assert got == {"k": (60, round(acc, 6)), "one": (1, 0.4)}


def test_ranked_bins(spark):
    import random

    rng = random.Random(4)
    rows = [(g, rng.choice([rng.randint(-50, 50), int(10 ** rng.uniform(0, 7))])) for g in ("a", None) for _ in range(800)] + [("one", 5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x bigint")
    for by in (["g"], []):
        for r in M.ranked(df, by, "x", [0, 50, 95, 100]).collect():
            xs = sorted(x for g, x in rows if x is not None and (not by or g == r.g))
            assert (r.n, r.p0, r.p50, r.p95, r.p100) == (len(xs), *(xs[min(len(xs) * p // 100, len(xs) - 1)] for p in (0, 50, 95, 100)))
    assert M.ranked(df.limit(0), ["g"], "x", [50]).count() == 0


def test_related_by_tags(spark):
    rows = [(i, "c", ["a", "b"] if i % 2 else ["a"]) for i in range(40)] + [(100, "c", ["b", "a", "z"]), (101, "d", ["a"])]
    df = spark.createDataFrame(rows, "doc_id bigint, category string, tags array<string>")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in D.related_by_tags(df, F.col("doc_id").isin(0, 1, 100, 101), 3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [(2, 1.0), (4, 1.0), (6, 1.0)] and [got[1, k] for k in (1, 2, 3)] == [(3, 1.0), (5, 1.0), (7, 1.0)]
    assert [got[100, k][0] for k in (1, 2, 3)] == [1, 3, 5] and (101, 1) not in got


def test_column_meanings():
    want = {
        "Address Line 1": "street", "addr2": "unit", "Street Address": "street", "streetName": "street", "house_no": "street_number", "Bldg Number": "street_number", "Apt #": "unit",
        "Town": "city", "CITY NAME": "city", "St": "state", "province": "state", "Postal-Code": "zip", "zip5": "zip", "zip_code": "zip", "zipCode": "zip", "Country Code": "country",
        "urb": "urbanization", "Mailing Address": "full_address", "full_address": "full_address", "customer.address.city": "city", "status": None, "notes": None, "": None, "id": None, "42": None,
    }
    assert {n: R.column_target(n) for n in want} == want


def test_known_mappings(spark):
    df = spark.createDataFrame([("1 Oak St", "x", "7001")], "Addr string, Town string, PostCode string")
    known: dict = {}
    out, mapping, sure = R.mapped_records(df, known)
    assert mapping == {"street": "Addr", "city": "Town", "zip": "PostCode"} and sure == 0.6375 and set(out.columns) == {"street", "city", "zip"}
    known[tuple(sorted(df.columns))] = {"city": "Addr"}
    assert R.mapped_records(df, known)[0].columns == ["city"]


def test_sketches(spark):
    from wayfold.operators import sketches as K

    df = spark.createDataFrame([(f"w{i % 50}",) for i in range(2000)] + [(None,)], "x string").withColumn("n", F.lit(1))
    got = {r.x: r.estimate for r in K.estimates(df, "x", K.count_min(df.select("x"), "x")).collect()}
    assert len(got) == 50 and all(v >= 40 for v in got.values()) and sum(v == 40 for v in got.values()) > 40
    bits = K.bloom(df, "x")
    asked = spark.createDataFrame([("w1",), ("nope",), (None,)], "x string")
    assert {r.x: r.seen for r in K.may_be_in(asked, "x", bits).collect()} == {"w1": True, "nope": False}
    assert K.may_be_in(asked, "x", K.bloom(df.limit(0), "x")).where("seen").count() == 0
    left = K.counting_filter(df.distinct(), df.distinct().where("x <> 'w3'"), "x")
    assert {r.x for r in K.may_be_in(df, "x", left.select("cell")).where("seen").collect()} == {"w3"}


def test_match_cascade(spark):
    rows = [(1, "12 Oak St", "Oakton", "NJ", "07001"), (2, "12 Oak St", "Oakton", "NJ", "07001"), (3, "12 Oakly St", "Oakton", "NJ", "07001"), (4, None, None, None, None)]
    p = A.parse(spark.createDataFrame(rows, "id int, address string, city string, state string, zip string"))
    got = {(r.p_id, r.i_id): r for r in A.match_cascade(p, p, "id", "id").collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 1), (3, 2)} and got[1, 2].match_type == "exact" and got[3, 1].match_type == "fuzzy_zip"
    assert got[3, 1].parts["zip"] == 1.0 and got[3, 1].parts["name"] < 1 and got[3, 1].parts["overall"] == pytest.approx(got[3, 1].score)
    best = {r.p_id: (r["rank"], r.i_id) for r in A.fuzzy_matches(p, p, "id", "id", limit=1, same_number=False, itself=False).collect()}
    assert best[1] == (1, 2) and best[3] == (1, 1)


def test_every_address(spark):
    move = "array<struct<from_address:string,to_address:string,city:string,state:string,zip:string,move_date:date>>"
    df = spark.createDataFrame([("A", "1 A St", [("0 X St", "1 A St", None, None, None, None), (None, " ", None, None, None, None)]), ("B", None, None)], f"crid string, address string, move_history {move}")
    assert {tuple(r) for r in C.every_address(df).collect()} == {("A", "1 A St"), ("A", "0 X St")}
