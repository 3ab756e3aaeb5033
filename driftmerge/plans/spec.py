"""What is declared of a replicated table, and whether it may be replicated at all."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NAME = 1900
MAX_KEY_COLUMNS = 128


class SpecError(ValueError):
    """A table that can't be replicated as declared."""


class Algo(Enum):
    """Conflict-free types of a table. The last two are accepted names of the first one's behaviour."""

    CLS = "cls"
    GOS = "gos"
    DWS = "dws"
    AWS = "aws"

    @property
    def grow_only(self) -> bool:
        return self is Algo.GOS

    @staticmethod
    def named(name: str) -> Algo:
        """By short or long name, in any case."""
        long = {"causallengthset": "cls", "growonlyset": "gos", "deletewinsset": "dws", "addwinsset": "aws"}
        try:
            return Algo(long.get(name.lower(), name.lower()))
        except (ValueError, AttributeError):
            raise SpecError(f"unknown algorithm {name!r}") from None


@dataclass(frozen=True)
class TableSpec:
    """Name, key columns, value columns in order, defaults of value columns, and algorithm of a replicated table."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    algo: Algo = Algo.CLS

    @property
    def values(self) -> tuple[str, ...]:
        keys = {k.lower() for k in self.key}
        return tuple(f.name for f in self.schema if f.name.lower() not in keys)

    @property
    def key_only(self) -> bool:
        return not self.values

    def kind(self, column: str) -> T.DataType:
        return next(f.dataType for f in self.schema if f.name.lower() == column.lower())

    def validate(self, force: bool = False) -> TableSpec:
        """self, or SpecError; force admits a single integer key."""
        if not self.name:
            raise SpecError("a table needs a name")
        if len(self.name) > MAX_NAME:
            raise SpecError(f"a table's name has {MAX_NAME} characters at most")
        if len(self.key) > MAX_KEY_COLUMNS:
            raise SpecError(f"{self.name}: {MAX_KEY_COLUMNS} key columns at most")
        if not self.key:
            raise SpecError(f"{self.name}: no key columns")
        fields = {f.name.lower(): f for f in self.schema}
        if missing := [k for k in self.key if k.lower() not in fields]:
            raise SpecError(f"{self.name}: no such key columns: {', '.join(missing)}")
        keys = [fields[k.lower()] for k in self.key]
        if len(keys) == 1 and isinstance(keys[0].dataType, T.IntegralType) and not force:
            raise SpecError(f"{self.name}: a single integer key isn't unique across replicas; use UUIDs or force")
        if nullable := [f.name for f in keys if f.nullable]:
            raise SpecError(f"{self.name}: key columns that may be null: {', '.join(nullable)}")
        held = {k.lower() for k in self.defaults}
        if bare := [c for c in self.values if not fields[c.lower()].nullable and c.lower() not in held]:
            raise SpecError(f"{self.name}: value columns that may not be null and have no default: {', '.join(bare)}")
        return self

    def check_keys(self, rows: DataFrame) -> TableSpec:
        """self, or SpecError if a row lacks part of its key (files come back nullable whatever was declared)."""
        lacking = F.lit(False)
        for k in self.key:
            lacking = lacking | F.col(f"`{k}`").isNull()
        if not rows.where(lacking).isEmpty():
            raise SpecError(f"{self.name}: rows whose key is null")
        return self

    def ddl(self) -> str:
        """The declaration as text, for the schema's hash."""
        columns = ", ".join(f'"{f.name}" {f.dataType.simpleString()}{"" if f.nullable else " NOT NULL"}' for f in self.schema)
        return f'CREATE TABLE "{self.name}" ({columns}, PRIMARY KEY ({", ".join(self.key)}));'
