"""A replica: tables with their clocks as versioned Parquet, and the operations on them.

Every write makes new folders and then puts their names into ``state.json``; until then the old state holds. Rows and clocks
only pass through Spark; the state file has names, cursors and settings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import codec
from driftmerge.functions import values as V
from driftmerge.functions.clock import TOMBSTONE, VERSION, uuid7
from driftmerge.functions.staging import stage
from driftmerge.operators import alter, capture, merge, policy
from driftmerge.operators.feed import feed
from driftmerge.plans.schema import SchemaHistory
from driftmerge.plans.spec import Algo, SpecError, TableSpec
from driftmerge.sources import files
from driftmerge.sources.payload import CHANGES

CURSORS = ("send_dbversion", "send_seq")


class Replica:
    """Opened at a folder, made there if it doesn't exist."""

    def __init__(self, spark: SparkSession, path: str, site_id: bytes | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._off: set[str] = set()  # of this session only
        #: What became of the changes applied last: received, applied, and how many were skipped for which reason.
        self.report: dict = {"received": 0, "applied": 0, "skipped": {}}
        if files.exists(spark, f"{self.path}/state.json"):
            self._state = files.read_json(spark, f"{self.path}/state.json")
        else:
            self._state = {"site_id": (site_id or uuid7()).hex(), "tables": {}, "settings": {"version": VERSION}, "table_settings": {}, "schemas": [], "cursors": dict.fromkeys(CURSORS, 0), "received": {}, "pre_alter_dbversion": 0}
            self._commit()

    def _commit(self) -> None:
        files.write_json(self.spark, f"{self.path}/state.json", self._state)

    @property
    def site_id(self) -> bytes:
        return bytes.fromhex(self._state["site_id"])

    def _held(self, name: str) -> dict:
        found = self._state["tables"].get(name.lower())
        if found is None:
            raise SpecError(f"{name} isn't enabled")
        return found

    def spec(self, name: str) -> TableSpec:
        t = self._held(name)
        return TableSpec(t["name"], T.StructType.fromJson(t["schema"]), tuple(t["key"]), t["defaults"], Algo(t["algo"]))

    @property
    def specs(self) -> list[TableSpec]:
        return [self.spec(n) for n in self._state["tables"]]

    def _put(self, spec: TableSpec, base: DataFrame, clocks: DataFrame) -> None:
        made = {}
        for kind, df in (("base", base), ("clocks", clocks)):
            made[kind] = f"{kind}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{made[kind]}")
        self._state["tables"][spec.name.lower()] = {"name": spec.name, "schema": spec.schema.jsonValue(), "key": list(spec.key), "defaults": spec.defaults, "algo": spec.algo.value} | made

    def _schemas(self) -> SchemaHistory:
        history = SchemaHistory([int(x, 16) for x in self._state["schemas"]])
        if self._state["tables"]:
            history.update(self.specs)
        self._state["schemas"] = [f"{x:016x}" for x in history.hashes]
        return history

    @property
    def schemas(self) -> SchemaHistory:
        return self._schemas()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.spec(name).schema).parquet(f"{self.path}/{self._held(name)['base']}")

    def clocks(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._held(name)['clocks']}")

    # Configuration.

    def enable(self, spec: TableSpec, rows: DataFrame, force: bool = False) -> None:
        """Replicate a table that has rows already; again for one that is, a change of algorithm excepted, does nothing."""
        held = self._state["tables"].get(spec.name.lower())
        if held:
            if held["algo"] != spec.algo.value:
                raise SpecError(f"{spec.name}: clean up before the algorithm is changed")
            self._off.discard(spec.name.lower())
            return
        spec.validate(force).check_keys(rows)
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in spec.schema))
        none = self._no_clocks(spec)
        self._put(spec, rows, capture.backfilled(rows, none, list(spec.key), list(spec.values), self.db_version() + 1, self.site_id))
        self._schemas()
        self._commit()

    def enable_all(self, keys: dict[str, tuple[str, ...]], algo: Algo = Algo.CLS, force: bool = False) -> None:
        """Replicate every table and view of the session's catalogue, none if one isn't eligible; keys has the key columns of each. A view of the feed is no table."""
        found = []
        for t in self.spark.catalog.listTables():
            key, rows = tuple(keys.get(t.name, ())), self.spark.table(f"`{t.name}`")
            if not key and set(rows.columns) == set(CHANGES.names):  # the feed's own view, as driftmerge.sql makes it
                continue
            held = {k.lower() for k in key}
            fields = [T.StructField(f.name, f.dataType, f.nullable and f.name.lower() not in held) for f in rows.schema]
            found.append((TableSpec(t.name, T.StructType(fields), key, algo=algo).validate(force).check_keys(rows), rows))
        for spec, rows in found:
            self.enable(spec, rows, force)

    def _no_clocks(self, spec: TableSpec) -> DataFrame:
        key = [T.StructField(k, spec.kind(k)) for k in spec.key]
        rest = [T.StructField("col_name", T.StringType()), T.StructField("col_version", T.LongType()), T.StructField("db_version", T.LongType()), T.StructField("site_id", T.BinaryType()), T.StructField("seq", T.LongType())]
        return self.spark.createDataFrame([], T.StructType([*key, *rest]))

    def set_enabled(self, name: str, on: bool) -> None:
        """Whether writes are captured, in this session; '*' for all tables."""
        for n in self._state["tables"] if name == "*" else [name.lower()]:
            (self._off.discard if on else self._off.add)(n)

    def is_enabled(self, name: str) -> bool:
        return name.lower() in self._state["tables"] and name.lower() not in self._off

    def cleanup(self, name: str) -> None:
        """Forget a table's clocks and settings, its rows stay where they are; '*' forgets the replica: all but the tables' rows goes."""
        if name == "*":
            files.delete(self.spark, f"{self.path}/state.json")
            self.vacuum(clocks=False)
            self._state |= {"tables": {}, "table_settings": {}, "schemas": [], "cursors": dict.fromkeys(CURSORS, 0), "received": {}}
            return
        t = self._state["tables"].pop(name.lower(), None)
        self._state["table_settings"].pop(name.lower(), None)
        if t:
            files.delete(self.spark, f"{self.path}/{t['clocks']}")
        self._commit()

    def vacuum(self, clocks: bool = True) -> int:
        """Delete folders of versions that no longer hold (and all clocks, if they aren't wanted); how many. For when nobody reads them."""
        held = {t["base"] for t in self._state["tables"].values()} | {t["clocks"] for t in self._state["tables"].values() if clocks}
        gone = [n for n in files.names(self.spark, self.path) if n.startswith(("base-", "clocks-")) and n not in held]
        for n in gone:
            files.delete(self.spark, f"{self.path}/{n}")
        return len(gone)

    def set(self, key: str | None, value) -> None:
        """A setting of the replica; None as value deletes it, as key does nothing."""
        if key is not None:
            self._state["settings"] = {k: v for k, v in self._state["settings"].items() if k.lower() != key.lower()} | ({} if value is None else {key.lower(): value})
            self._commit()

    def get(self, key: str, default=0):
        return self._state["settings"].get(key.lower(), default)

    def set_table(self, name: str, key: str | None, value) -> None:
        self.set_column(name, "*", key, value)

    def set_column(self, name: str, column: str, key: str | None, value) -> None:
        """A setting of a table ('*') or column, one for each key; None as value deletes it, as key all of the table's."""
        held = self._state["table_settings"].setdefault(name.lower(), {})
        if key is None:
            held.clear()
        elif value is None:
            held.pop(key, None)
        else:
            held[key] = {"column": column, "value": value}
        self._commit()

    def table_settings(self, name: str) -> dict:
        return self._state["table_settings"].get(name.lower(), {})

    def cursor(self, name: str) -> int:
        return self._state["cursors"][name]

    def set_cursors(self, **at: int) -> None:
        self._state["cursors"] |= at
        self._commit()

    @property
    def received(self) -> dict[str, int]:
        """Number of the last batch that was merged, by the id of the site that sent it."""
        return dict(self._state.get("received", {}))

    def set_received(self, last: dict[str, int]) -> None:
        self._state["received"] = dict(last)
        self._commit()

    # Versions and changes.

    def db_version(self) -> int:
        """Newest version of all clocks, or that stored before an alteration."""
        newest = [self._state["pre_alter_dbversion"]]
        newest += [self.clocks(n).agg(F.max("db_version")).first()[0] or 0 for n in self._state["tables"]]
        return max(newest)

    def logical_changes(self, name: str) -> DataFrame:
        """The feed of one table with its key's own columns."""
        spec = self.spec(name)
        return feed(self.clocks(name), self.table(name), list(spec.key), list(spec.values))

    def changes(self, *names: str) -> DataFrame:
        """The feed of some or all tables: tbl, pk (encoded key) and the columns of a change."""
        found = None
        for n in names or self._state["tables"]:
            spec = self.spec(n)
            pk = codec.key_of([(F.col(f"`{k}`"), spec.kind(k)) for k in spec.key])
            one = self.logical_changes(n).select(F.lit(spec.name).alias("tbl"), pk.alias("pk"), "col_name", "col_value", "col_version", "db_version", "site_id", "cl", "seq")
            found = one if found is None else found.unionByName(one)
        return self.spark.createDataFrame([], CHANGES) if found is None else found

    def write(self, name: str, after: DataFrame, moves: DataFrame | None = None) -> None:
        """One transaction: the table becomes ``after``. moves (key columns, and the same with the prefix new_) says which rows changed their keys."""
        spec, before, clocks = self.spec(name), self.table(name), self.clocks(name)
        after = after.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in spec.schema))
        if self.is_enabled(name):
            key, columns, version = list(spec.key), list(spec.values), self.db_version() + 1
            if moves is not None:
                clocks = capture.applied(clocks, capture.captured_moves(moves, clocks, key, version, self.site_id), key)
                new = moves.select(*key, *(F.col(f"new_{k}") for k in key))
                before = before.join(new, key, "left").select(*(F.coalesce(F.col(f"new_{k}"), F.col(k)).alias(k) for k in key), *columns)
            clocks = capture.capture(before, after, clocks, key, columns, version, self.site_id, spec.algo.grow_only)
        self._put(spec, after, clocks)
        self._commit()

    def apply(self, changes: DataFrame, allowed: Column | None = None) -> int:
        """Merge changes (columns of CHANGES) of other replicas; the number that came in. allowed is judged on each change, by transactions.

        Rows that no change wins in stay as they are, written with capture or without. Changes of tables or columns that aren't
        there, keys that can't be decoded, and what a column ``error`` gives a reason for are skipped and counted in ``report``.
        """
        changes = changes if "error" in changes.columns else changes.withColumn("error", F.lit(None).cast("string"))
        specs = {n: self.spec(n) for n in self._state["tables"]}
        if allowed is not None:
            bad = changes.where("error is not null")
            changes = policy.gated(changes.where("error is null"), allowed)[0].unionByName(bad)
        if all(len(spec.key) == 1 and isinstance(spec.kind(spec.key[0]), T.LongType) for spec in specs.values()):
            changes = changes.withColumn("_int", codec.integer_key(F.col("pk"))).withColumn("_key", F.when(F.col("_int").isNotNull(), F.array(V.to_value(F.col("_int"), T.LongType())))).drop("_int")
        else:
            changes = changes.withColumn("_key", codec.decoded_key(F.col("pk")))
        reason, there = F.col("error"), F.lit(False)
        for name, spec in specs.items():
            mine = F.lower("tbl") == name
            there = there | mine
            whole = F.col("_key").isNotNull() & (F.size("_key") == len(spec.key))
            for i, k in enumerate(spec.key):
                whole = whole & V.from_value(F.get("_key", F.lit(i)), spec.kind(k)).isNotNull()
            reason = F.coalesce(reason, F.when(mine & ~F.coalesce(whole, F.lit(False)), "a key that can't be decoded"), F.when(mine & ~F.coalesce(F.col("col_name").isin(*spec.values, TOMBSTONE), F.lit(False)), "an unknown column"))
        lacking = F.col("cl").isNull() | F.col("col_version").isNull() | F.col("db_version").isNull() | F.col("seq").isNull() | F.col("col_value").isNull()
        reason = F.coalesce(reason, F.when(~F.coalesce(there, F.lit(False)), "an unknown table"), F.when(lacking, "an incomplete change"))
        changes = stage(changes.withColumn("error", reason))
        counted = {r.error: r["count"] for r in changes.groupBy("error").count().collect()}  # a row for each reason
        version = self.db_version()
        for name, spec in specs.items():
            key, columns = list(spec.key), list(spec.values)
            incoming = changes.where((F.lower("tbl") == name) & F.col("error").isNull())
            incoming = incoming.select(*(V.from_value(F.col("_key")[i], spec.kind(k)).alias(k) for i, k in enumerate(key)), *merge.CHANGE)
            local = merge.unseen(self.logical_changes(name))
            # The merged rows are staged once; rows and clocks are both made of them, without another aggregation.
            state = stage(merge.merged_with(local, incoming, key, columns, spec.algo))
            won = merge.merged_cells(state, key, columns, version)
            base = merge.upserted(self.table(name), state, key, {c: spec.kind(c) for c in columns}, spec.defaults, spec.algo)
            self._put(spec, base.select(*(F.col(f"`{f.name}`") for f in spec.schema)), won.select(*key, "col_name", "col_version", "db_version", "site_id", "seq"))
        self._commit()
        received = sum(counted.values())
        self.report = {"received": received, "applied": counted.pop(None, 0), "skipped": counted}
        return received

    def alter(self, name: str, new: TableSpec, change: Callable[[DataFrame], DataFrame]) -> None:
        """Change a table's schema: new is its declaration afterwards, change turns its rows into those of the new schema."""
        old, version = self.spec(name), self.db_version()
        rows = change(self.table(name)).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in new.schema))
        new = replace(new, algo=old.algo).validate(force=True).check_keys(rows)
        clocks = alter.evolved(self.clocks(name), rows, list(old.key), list(new.key), list(new.values), version + 1, self.site_id)
        self._state["pre_alter_dbversion"] = max(version, self._state["pre_alter_dbversion"])
        if new.name.lower() != name.lower():
            del self._state["tables"][name.lower()]
        self._put(new, rows, clocks)
        self._schemas()
        self._commit()

    def terminate(self) -> None:
        """Drop what this session holds; the replica opens again from its folder."""
        self._off.clear()
        self._state = files.read_json(self.spark, f"{self.path}/state.json")
