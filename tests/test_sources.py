"""Sources and sinks in files, and streams over them."""

import json

import pytest

from wayfold.sources import files as S
from wayfold.streaming import streams as T


def test_customers(spark, tmp_path):
    assert S.customers(spark, str(tmp_path / "none.json")).count() == 0
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"crid": "CRID-000001", "move_count": 2, "move_history": [{"to_address": "x", "move_date": "2024-01-02"}]}, {"crid": "CRID-000002"}]))
    got = {r.crid: r for r in S.customers(spark, str(p)).collect()}
    assert got["CRID-000001"].move_history[0].to_address == "x" and got["CRID-000002"].move_count is None


def test_export(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"records": [{"id": "7", "address": "1 A", "state": "nj"}, {"street": "2 B", "zip_code": "1"}]}))
    assert sorted((r.id, r.address, r.state, r.zip) for r in S.export(spark, str(p)).collect()) == [("7", "1 A", "NJ", None), ("ADDR-000001", "2 B", None, "1")]


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_delimited(spark, tmp_path, sep):
    p = tmp_path / "d.csv"
    p.write_text(f"Id{sep}Full Name\n1{sep} Ann \n2{sep}N/A\n")
    assert S.delimiter(spark, str(p)) == sep
    assert [tuple(r) for r in S.delimited(spark, str(p)).orderBy("id").collect()] == [("1", "Ann"), ("2", None)]


def test_json(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.jsonl"
    a.write_text('[{"a": {"b": 1}}, {"a": {"b": 2}}]')
    b.write_text('{"a": {"b": 1}}\nnot json\n{"a": {"b": 2}}\n')
    for p in (a, b):
        assert sorted(r.a_b for r in S.read_any(spark, str(p)).collect()) == [1, 2]
    with pytest.raises(ValueError):
        S.read_any(spark, "x.unknown")
    with pytest.raises(NotImplementedError):
        S.read_any(spark, "x.pdf")


def test_text_blocks(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("one\n\n \n\ntwo\nthree")
    assert [(r.row_no, r.text) for r in S.text_blocks(spark, str(p)).orderBy("row_no").collect()] == [(1, "one"), (2, "two\nthree")]
    assert [r.text for r in S.text_blocks(spark, str(p), "block", 9).orderBy("row_no").collect()] == ["one\n\n \n\nt", "wo\nthree"]


def test_vectors_and_batch(spark, tmp_path):
    p = tmp_path / "v.vec"
    p.write_bytes(S.pack_vectors([("a", [1.0, 2.0]), ("bé", [3.0, 4.0])]))
    v = S.vectors(spark, str(p))
    assert {r.source_id: list(r.embedding) for r in v.collect()} == {"a": [1.0, 2.0], "bé": [3.0, 4.0]}
    df = spark.createDataFrame([("a", "1 A St", "Oakton"), ("", "2 B", None)], "ID string, Street string, City string")
    got = {r.raw_address: r for r in S.address_batch(df, v).collect()}
    assert got["1 A St, Oakton"].embedding == [1.0, 2.0] and len(got["2 B"].source_id) == 16


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [2], "x")], "b int, a array<int>, c string")
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["a", "b", "c"]
    S.write_table(df, str(tmp_path / "p"), ["c"])
    assert "PartitionFilters: [isnotnull(c" in spark.read.parquet(str(tmp_path / "p")).where("c = 'x'")._jdf.queryExecution().toString()
    name, got = S.first_source(spark, [("no", str(tmp_path / "no"), S.customers), ("yes", str(tmp_path / "p"), lambda s, p: s.read.parquet(p))])
    assert name == "yes" and got.count() == 1
    assert S.query_text(spark, "select b + :n as x from {t}", {"n": 1}, t=df).first().x == 2


def test_stream_goes_on_after_its_checkpoint(spark, tmp_path):
    src, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    df.write.parquet(src)
    assert T.run_once(T.files(spark, src), checkpoint=state, target=out).count() == 2
    spark.createDataFrame([(3, "c")], "id int, v string").write.mode("append").parquet(src)
    assert T.run_once(T.files(spark, src), checkpoint=state, target=out).count() == 3


def test_upserts_are_idempotent(spark, tmp_path):
    target = str(tmp_path / "t")
    write = T.upsert_into(target, "k", ["o", "v"])
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (3, 7, "a"), (3, 7, "b")], "k int, o int, v string")
    assert T.upserted(spark, target, a.schema).count() == 0
    for no, b in enumerate([a, spark.createDataFrame([(2, 5, "w"), (3, 6, "late")], "k int, o int, v string")]):
        write(b, no)
        write(b, no)
    assert sorted((r.k, r.v) for r in T.upserted(spark, target, a.schema).collect()) == [(1, "y"), (2, "w"), (3, "b")]
    newest = T.versions(spark, target)
    assert {p.split("/")[-2] for p in newest.values()} == {"v=0", "v=1"}  # buckets that a batch doesn't touch stay


def test_keyed_state_over_batches(spark, tmp_path):
    import datetime as dt

    def land(name, rows):
        spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), k, i, x) for s, k, i, x in rows], "ts timestamp, k string, trace_id string, x string").coalesce(1).write.parquet(f"{tmp_path}/{name}")

    land("in", [(0, "a", "1", "one"), (10, "a", "2", None), (20, "a", "3", "three"), (5, "b", "4", "four"), (5, None, "5", "five")])
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    run = lambda: T.run_once(T.limited(T.files(spark, str(tmp_path / "in")), "k", "ts", 2, 30), checkpoint=state, target=out)
    assert {(r.k, r.id): r.allowed for r in run().collect()} == {("a", "1"): True, ("a", "2"): True, ("a", "3"): False, ("b", "4"): True}
    held = lambda: {r.k: list(r.held) for r in T.run_once(T.session_memory(T.files(spark, str(tmp_path / "in")), "k", "ts", "x", "trace_id", keep=2), "update").collect()}
    assert held() == {"a": ["one", "three"], "b": ["four"]}
    land("more", [(25, "a", "6", "six"), (40, "a", "7", "seven")])
    for p in (tmp_path / "more").glob("part-*.parquet"):
        p.rename(tmp_path / "in" / f"more-{p.name}")
    got = {(r.k, r.id): r.allowed for r in run().collect()}
    assert len(got) == 6 and got["a", "6"] is False and got["a", "7"] is True  # the window began in the batch before
    assert held()["a"] == ["six", "seven"]


def test_windows_and_late_rows(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 0, m),) for m in (1, 2, 31, 59)]
    spark.createDataFrame(rows, "ts timestamp").write.parquet(str(tmp_path / "w"))
    got = T.run_once(T.bucket_counts(T.files(spark, str(tmp_path / "w")), "ts", "30 minutes", "10 minutes", []), "complete").collect()
    assert sorted(r.n for r in got) == [2, 2]
