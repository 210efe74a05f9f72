"""Naming rules: which role a column has by its name, and what names and document paths are accepted."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from docweave.errors import InvalidName, InvalidSelect, RequiredColumnMissing

MANAGED = ("created_at", "updated_at")
_IDENTIFIER = re.compile(r"[A-Za-z_]\w{0,62}")
_PATH = re.compile(r"[A-Za-z0-9_.\[\]]+")


@dataclass(frozen=True)
class ModelSchema:
    entity: str | None = None
    pk: str | None = None
    id: str | None = None
    identifier: str | None = None
    data: str | None = None
    fks: tuple[str, ...] = ()
    uuid_fks: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return {"entity_name": self.entity, "pk_column": self.pk, "id_column": self.id, "identifier_column": self.identifier, "data_column": self.data, "fk_columns": list(self.fks), "uuid_fk_columns": list(self.uuid_fks), "additional_columns_with_types": dict(self.extra)}


def classify(schema: T.StructType, strict_id: bool = False) -> ModelSchema:
    """Roles by name: the first ``pk_*`` names the entity; ``id``, ``identifier``, ``data``; ``fk_*`` are
    lineage keys and other ``*_id`` filter keys; the rest is extra, with its type."""
    pk = next((f.name for f in schema if f.name.startswith("pk_") and len(f.name) > 3), None)
    names = set(schema.names)
    rest = [f for f in schema if f.name not in {pk, "id", "identifier", "data", *MANAGED}]
    fks = tuple(f.name for f in rest if f.name.startswith("fk_"))
    uuid_fks = tuple(f.name for f in rest if f.name.endswith("_id") and not f.name.startswith("fk_"))
    if strict_id and "id" not in names:
        raise RequiredColumnMissing("column id is missing")
    return ModelSchema(pk[3:] if pk else None, pk, *(n if n in names else None for n in ("id", "identifier", "data")), fks, uuid_fks, {f.name: f.dataType.simpleString() for f in rest if f.name not in {*fks, *uuid_fks}})


# Column names, how they end, begin or what they hold, and the types they suggest; first match wins.
NAME_TYPES = (
    ("UUID", {"equal": ("id",), "end": ("_id",), "hold": ("uuid",)}),
    ("TEXT", {"hold": ("name", "title", "text", "description", "email")}),
    ("INTEGER", {"begin": ("pk_", "fk_"), "hold": ("count", "number", "size")}),
    ("TIMESTAMP", {"hold": ("date", "time", "created", "updated")}),
    ("BOOLEAN", {"begin": ("is_", "has_"), "hold": ("active", "enabled", "deleted")}),
)


def type_of_name(column: str) -> str:
    """The array element type that a column's name suggests; UUID when nothing fits."""
    name = column.lower()
    for kind, how in NAME_TYPES:
        if name in how.get("equal", ()) or name.startswith(how.get("begin", ())) or name.endswith(how.get("end", ())) or any(w in name for w in how.get("hold", ())):
            return kind
    return "UUID"


def view_of_fk(fk: str) -> str | None:
    return f"v_{fk[3:]}" if fk.startswith("fk_") and len(fk) > 3 else None


def entity_of_table(table: str) -> str | None:
    return table[3:] if table.startswith("tb_") and len(table) > 3 else None


def checked_identifier(name: str, prefixes: tuple[str, ...] = ()) -> str:
    """The name, if it is a plain identifier of at most 63 characters (with one of the prefixes)."""
    if not _IDENTIFIER.fullmatch(name) or (prefixes and not name.startswith(prefixes)):
        raise InvalidName(f"not an accepted name: {name!r}")
    return name


def path_steps(path: str) -> list[str | int]:
    """Steps of a dotted path with indexes, ``a.b[0].c``; at most 500 characters and 100 levels."""
    if not path or len(path) > 500 or not _PATH.fullmatch(path):
        raise InvalidName(f"not an accepted path: {path!r}")
    steps: list[str | int] = []
    for part in path.split("."):
        m = re.fullmatch(r"([A-Za-z0-9_]+)((?:\[\d{1,9}\])*)", part)
        if not m:
            raise InvalidName(f"not an accepted path: {path!r}")
        steps.append(m[1])
        steps += [int(i) for i in re.findall(r"\d+", m[2])]
    if len(steps) > 100:
        raise InvalidName("more than 100 levels")
    return steps


_CTAS = re.compile(r"\s*CREATE\s+TABLE\s+(?:(\w+)\.)?(tv_\w+)\s+AS\s+(.*?);?\s*", re.I | re.S)


def ctas_header(text: str) -> tuple[str, str] | None:
    """Model name and SELECT of ``CREATE TABLE [namespace.]tv_x AS SELECT ...``; None for other statements."""
    m = _CTAS.fullmatch(text)
    if not m:
        return None
    if not re.match(r"SELECT\b", m[3], re.I):
        raise InvalidSelect("a model is defined by a SELECT")
    return m[2], m[3]


def ctas_namespace(text: str) -> str | None:
    """The namespace that such a statement names."""
    m = _CTAS.fullmatch(text)
    return m[1] if m else None
