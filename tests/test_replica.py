"""Replicas that change tables apart and exchange changes end up equal."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.plans.schema import SchemaHistory, SchemaMismatch, normalised
from driftmerge.plans.spec import Algo, SpecError, TableSpec
from driftmerge.replica import Replica
from driftmerge.sources.transport import FolderTransport
from driftmerge.sql import install
from driftmerge.streaming import sync

PEOPLE = T.StructType([T.StructField("first", T.StringType(), False), T.StructField("last name", T.StringType(), False), T.StructField("age", T.LongType()), T.StructField("note", T.StringType())])
SPEC = TableSpec("people", PEOPLE, ("first", "last name"))


def people(spark, ids):
    return spark.createDataFrame([(f"name{i}", f"surname{i}", i, f"note{i}") for i in ids], PEOPLE)


def state(replica, name="people"):
    return sorted(map(tuple, replica.table(name).collect()), key=str)


def test_three_replicas_converge(spark, tmp_path):
    replicas = [Replica(spark, f"{tmp_path}/r{i}") for i in range(3)]
    wire = FolderTransport(spark, f"{tmp_path}/wire")
    for i, r in enumerate(replicas):
        r.enable(SPEC, people(spark, range(1 + 3 * i, 4 + 3 * i)))
    everyone = lambda: [sync.sync(r, wire) for r in replicas] + [sync.check(r, wire) for r in replicas]
    everyone()
    assert len(state(replicas[0])) == 9 and state(replicas[0]) == state(replicas[1]) == state(replicas[2])
    a, b, _ = replicas
    a.write("people", a.table("people").withColumn("age", F.when(F.col("first") == "name1", 40).otherwise(F.col("age"))).where("first <> 'name5'"))
    b.write("people", b.table("people").withColumn("note", F.when(F.col("first") == "name1", "other").otherwise(F.col("note"))))
    assert sync.has_unsent(a)
    everyone()
    assert state(replicas[0]) == state(replicas[1]) == state(replicas[2])
    merged = {r[0]: r for r in state(replicas[2])}
    assert merged["name1"][2:] == (40, "other") and "name5" not in merged
    moves = spark.createDataFrame([("name8", "surname8", "name88", "surname8")], "first string, `last name` string, new_first string, `new_last name` string")
    b.write("people", b.table("people").withColumn("first", F.when(F.col("first") == "name8", "name88").otherwise(F.col("first"))), moves)
    everyone()
    assert state(replicas[0]) == state(replicas[1]) == state(replicas[2]) and {r[0] for r in state(replicas[0])} >= {"name88"} and "name8" not in {r[0] for r in state(replicas[0])}
    assert not sync.has_unsent(b)
    assert sync.check(a, wire) == 0
    sync.reset(a)
    before = state(a)
    sync.check(a, wire)
    assert state(a) == before  # merging again changes nothing


def test_configuration(spark, tmp_path):
    r = Replica(spark, f"{tmp_path}/r", bytes(15) + b"\1")
    r.enable(SPEC, people(spark, [1]))
    r.enable(SPEC, people(spark, [1, 2]))  # already there
    assert len(state(r)) == 1 and r.is_enabled("PEOPLE") and not r.is_enabled("other") and r.db_version() == 1
    r.set_enabled("*", False)
    r.write("people", people(spark, [1, 2]))
    assert r.db_version() == 1 and len(state(r)) == 2
    r.terminate()
    assert r.is_enabled("people")
    r.set("Key", "v")
    assert r.get("key") == "v" and r.get("none") == 0
    r.set("key", None)
    assert r.get("key") == 0
    r.set_column("people", "age", "algo", "x")
    r.set_table("people", "algo", "y")
    assert r.table_settings("people") == {"algo": {"column": "*", "value": "y"}}
    with pytest.raises(SpecError):
        r.enable(TableSpec("people", PEOPLE, SPEC.key, algo=Algo.GOS), people(spark, [1]))
    r.cleanup("people")
    assert not r.is_enabled("people") and Replica(spark, f"{tmp_path}/r").site_id == bytes(15) + b"\1"
    r.cleanup("*")
    assert Replica(spark, f"{tmp_path}/r").site_id != bytes(15) + b"\1"


def test_apply_keeps_what_was_written_without_capture(spark, tmp_path):
    a, b = (Replica(spark, f"{tmp_path}/{x}") for x in "ab")
    a.enable(SPEC, people(spark, [1, 2, 4]))
    b.enable(SPEC, people(spark, [3]))
    a.set_enabled("people", False)
    a.write("people", people(spark, [1, 5]).withColumn("note", F.when(F.col("first") == "name1", "quiet").otherwise(F.col("note"))))
    b.apply(a.changes().where("pk is null"))  # nothing at all
    a.apply(b.changes())
    assert state(a) == [("name1", "surname1", 1, "quiet"), ("name3", "surname3", 3, "note3"), ("name5", "surname5", 5, "note5")]
    c = Replica(spark, f"{tmp_path}/c")
    c.enable(SPEC, people(spark, [4]).withColumn("age", F.lit(44)))
    a.apply(c.changes().where("col_name = 'age'"))  # wins in a row that isn't there any more
    assert ("name4", "surname4", 44, None) in state(a) and len(state(a)) == 4
    d = Replica(spark, f"{tmp_path}/d")
    d.enable(SPEC, people(spark, [1]))
    d.write("people", people(spark, []))
    a.apply(d.changes())
    assert "name1" not in [r[0] for r in state(a)] and len(state(a)) == 3
    d.write("people", people(spark, [1]))
    a.apply(d.changes().where("col_name = '__[RIP]__'"))  # comes back, with defaults
    assert ("name1", "surname1", None, None) in state(a)


def test_bad_changes_are_skipped_and_counted(spark, tmp_path):
    a, b = (Replica(spark, f"{tmp_path}/{x}") for x in "ab")
    a.enable(SPEC, people(spark, [1, 2]))
    b.enable(SPEC, people(spark, []))
    good = a.changes()
    odd = good.limit(1)
    bad = [odd.withColumn("pk", F.unhex(F.lit("01"))), odd.withColumn("tbl", F.lit("other")), odd.withColumn("col_name", F.lit("none")), odd.withColumn("cl", F.lit(None).cast("long"))]
    changes = good
    for x in bad:
        changes = changes.unionByName(x)
    assert b.apply(changes) == 8 and state(b) == state(a)
    assert b.report == {"received": 8, "applied": 4, "skipped": {"a key that can't be decoded": 1, "an unknown table": 1, "an unknown column": 1, "an incomplete change": 1}}


def test_no_batch_is_missed(spark, tmp_path):
    a, b, c = (Replica(spark, f"{tmp_path}/{x}") for x in "abc")
    for i, r in enumerate((a, b, c)):
        r.enable(SPEC, people(spark, [i]))
    wire = FolderTransport(spark, f"{tmp_path}/wire")
    sync.send(b, wire)
    folder = next((tmp_path / "wire").glob(f"*{b.site_id.hex()}"))
    (folder / "_SUCCESS").rename(tmp_path / "aside")  # b is still uploading
    sync.send(a, wire)
    assert sync.check(c, wire) == 2 and sync.check(c, wire) == 0
    (tmp_path / "aside").rename(folder / "_SUCCESS")
    assert sync.check(c, wire) == 2 and len(state(c)) == 3
    assert Replica(spark, f"{tmp_path}/c").received == {x.site_id.hex(): 1 for x in (a, b)}


def test_all_tables_and_cleanup(spark, tmp_path):
    people(spark, [1]).createOrReplaceTempView("people")
    try:
        r = Replica(spark, f"{tmp_path}/r")
        with pytest.raises(SpecError):
            r.enable_all({})
        assert not r.is_enabled("people")
        r.enable_all({t.name: SPEC.key for t in spark.catalog.listTables() if t.name == "people"})
        assert r.is_enabled("people") and len(state(r)) == 1
    finally:
        spark.catalog.dropTempView("people")
    r.write("people", people(spark, [1, 2]))
    assert r.vacuum() == 2 and r.vacuum() == 0 and len(state(r)) == 2
    r.cleanup("*")
    assert [x.name.split("-")[0] for x in (tmp_path / "r").iterdir() if not x.name.startswith(".")] == ["base"]


def test_names_for_sql(spark, tmp_path):
    a = Replica(spark, f"{tmp_path}/a", bytes(15) + b"\7")
    a.enable(SPEC, people(spark, [1, 2]))
    install(a.changes(), a.site_id)
    one = spark.sql("select drift_version() as v, hex(drift_site_id()) as s, drift_db_version() as d, drift_row_id(3, 4) as r, drift_row_id(3, 1 << 31) as n, drift_row_id_seq(drift_row_id(3, 4)) as q, drift_uuid_compare(X'01', X'02') as c").first()
    assert (one.s, one.d, one.r, one.n, one.q, one.c) == ("00" * 15 + "07", 1, 3 * 2**30 + 4, None, 4, -1)
    assert spark.sql("select * from drift_changes_since(1, 1)").count() == 2 and spark.sql("select * from drift_changes_of('PEOPLE') where col_name = 'age'").count() == 2
    assert {r[0] for r in spark.sql("select drift_pk_values(pk)[0].s from drift_changes").collect()} == {"name1", "name2"}


def test_grow_only(spark, tmp_path):
    r = Replica(spark, f"{tmp_path}/r")
    r.enable(TableSpec("people", PEOPLE, SPEC.key, algo=Algo.named("GrowOnlySet")), people(spark, [1]))
    r.write("people", people(spark, [1, 2]))
    with pytest.raises(ValueError):
        r.write("people", people(spark, [2]))


def test_policy_takes_whole_transactions(spark, tmp_path):
    a, b = (Replica(spark, f"{tmp_path}/{x}") for x in "ab")
    a.enable(SPEC, people(spark, [1]))
    a.write("people", people(spark, [1, 2, 3]))
    b.enable(SPEC, people(spark, []))
    b.apply(a.changes(), F.coalesce(F.col("col_value.i"), F.lit(0)) < 3)
    assert [r[0] for r in state(b)] == ["name1"]


def test_schemas(spark, tmp_path):
    a, b = (Replica(spark, f"{tmp_path}/{x}") for x in "ab")
    wire = FolderTransport(spark, f"{tmp_path}/wire")
    for r in (a, b):
        r.enable(SPEC, people(spark, [1]))
    wider = TableSpec("people", T.StructType([*PEOPLE.fields, T.StructField("more", T.StringType())]), SPEC.key)
    a.alter("people", wider, lambda df: df.withColumn("more", F.lit("x")))
    assert {c.col_name for c in a.clocks("people").collect()} == {"age", "note", "more"}
    sync.send(a, wire)
    with pytest.raises(Exception, match="schema hash"):
        sync.check(b, wire)
    b.alter("people", wider, lambda df: df.withColumn("more", F.lit(None).cast("string")))
    sync.check(b, wire)
    assert state(b) == [("name1", "surname1", 1, "note1", "x")]
    b.alter("people", SPEC, lambda df: df)
    assert {c.col_name for c in b.clocks("people").collect()} == {"age", "note"}
    sync.logout(b)
    assert state(b) == [] and b.is_enabled("people") and b.received == {}
    history = SchemaHistory([1])
    with pytest.raises(SchemaMismatch):
        history.require(2)
    assert normalised("CREATE  TABLE t ( a INT ) ; -- x") == "create table t( a int)"


def test_eligibility():
    field = lambda n, k=T.StringType(), null=False: T.StructField(n, k, null)
    table = lambda fields, key, **x: TableSpec(x.pop("name", "t"), T.StructType(fields), key, **x)
    bad = [table([field("a")], ()), table([field("a", null=True)], ("a",)), table([field("a", T.LongType())], ("a",)), table([field("a"), field("b")], ("a",)), table([field("a")], ("z",)), table([field("a")], ("a",), name="x" * 1901), table([field("a")], ("a",), name=""), table([field(f"c{i}") for i in range(130)], tuple(f"c{i}" for i in range(130)))]
    for spec in bad:
        with pytest.raises(SpecError):
            spec.validate()
    table([field("a", T.LongType())], ("a",)).validate(force=True)
    table([field("a"), field("b")], ("a",), defaults={"b": "x"}).validate()
    assert Algo.named("CLS") is Algo.CLS and Algo.named("deletewinsset") is Algo.DWS
    with pytest.raises(SpecError):
        Algo.named("other")


def test_the_feeds_own_view_is_no_table(spark, tmp_path):
    people(spark, [1]).createOrReplaceTempView("people")
    try:
        r = Replica(spark, f"{tmp_path}/r")
        r.changes().createOrReplaceTempView("drift_changes")
        r.enable_all({"people": SPEC.key})
        assert r.is_enabled("people") and not r.is_enabled("drift_changes")
    finally:
        for view in ("people", "drift_changes"):
            spark.catalog.dropTempView(view)
