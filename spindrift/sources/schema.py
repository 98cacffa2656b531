"""Declared table schemas: typed columns that are stored, defaulted, materialised or aliases."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

TYPES: dict[str, DataType] = {"int64": LongType(), "timestamp_ms": LongType(), "float64": DoubleType(), "utf8": StringType(), "bool": BooleanType()}
HINT = "spindrift:type"  # field metadata of the types that share a stored type
KINDS = ("default", "materialized", "alias")


class SchemaError(ValueError):
    """A schema, sort key or column expression that is not allowed."""


class UnsupportedType(SchemaError):
    pass


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    kind: str = "stored"
    expr: str | None = None
    bloom: bool = False

    @property
    def field(self) -> StructField:
        return StructField(self.name, TYPES[self.type], self.nullable, {HINT: self.type} if self.type == "timestamp_ms" else None)


@dataclass(frozen=True)
class TableColumns:
    columns: tuple[Column, ...]

    @staticmethod
    def parse(spec: str | dict) -> TableColumns:
        """From `{"fields": [{name, type, nullable?, default? | materialized? | alias?, bloom_filter?}]}`."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        out: list[Column] = []
        for f in spec.get("fields") or []:
            if f["type"] not in TYPES:
                raise UnsupportedType(f"column {f['name']}: type {f['type']!r} is not one of {', '.join(TYPES)}")
            kinds = [k for k in KINDS if f.get(k) is not None]
            if len(kinds) > 1:
                raise SchemaError(f"column {f['name']}: {' and '.join(kinds)} exclude each other")
            kind = kinds[0] if kinds else "stored"
            if kind == "alias" and f.get("bloom_filter"):
                raise SchemaError(f"column {f['name']}: an alias is not stored and has no bloom filter")
            if any(c.name == f["name"] for c in out):
                raise SchemaError(f"column {f['name']} is declared twice")
            out.append(Column(f["name"], f["type"], bool(f.get("nullable", True)), kind, f.get(kind), bool(f.get("bloom_filter", False))))
        if not out:
            raise SchemaError("a table has at least one column")
        return TableColumns(tuple(out))

    def json(self) -> str:
        fields = []
        for c in self.columns:
            f = {"name": c.name, "type": c.type, "nullable": c.nullable}
            if c.expr is not None:
                f[c.kind] = c.expr
            if c.bloom:
                f["bloom_filter"] = True
            fields.append(f)
        return json.dumps({"fields": fields})

    def of(self, *kinds: str) -> StructType:
        return StructType([c.field for c in self.columns if c.kind in kinds])

    @property
    def input(self) -> StructType:
        """What a producer may send."""
        return self.of("stored", "default")

    @property
    def physical(self) -> StructType:
        """What files hold."""
        return self.of("stored", "default", "materialized")

    @property
    def query(self) -> StructType:
        """What a reader sees."""
        return self.of("stored", "default", "materialized", "alias")


def check_sort_key(columns: TableColumns, sort_key: list[str], packing_key: str, time: str | None = None) -> None:
    """The sort key begins with the packing key, names stored columns, and holds the time column if there is one."""
    names = columns.physical.names
    if not sort_key or sort_key[0] != packing_key:
        raise SchemaError(f"the sort key begins with the packing key {packing_key!r}")
    if missing := [c for c in sort_key if c not in names]:
        raise SchemaError(f"the sort key names unknown columns: {', '.join(missing)}")
    if time is not None and time not in sort_key:
        raise SchemaError(f"the sort key lacks the time column {time!r}")
    if columns.physical[packing_key].dataType != LongType():
        raise SchemaError("the packing key is an int64")


def type_name(field: StructField) -> str:
    """Result type name: the hint if the column still carries it, else the core type, else Spark's own name."""
    if field.metadata.get(HINT):
        return field.metadata[HINT]
    known = {v: k for k, v in TYPES.items() if k != "timestamp_ms"}
    return known.get(field.dataType, field.dataType.simpleString())
