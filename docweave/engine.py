"""The engine: read models defined by SELECTs over base tables, kept equal to them as batches of changes arrive.

A change batch is a set: changed rows carry their image before and after, keys are closed over foreign
keys level by level (referenced models first), the defining query is re-evaluated for affected keys only
and merged into versioned tables; one manifest publishes all of it. Where all that changed in a model is an
embedded document, that field is patched instead. A source whose effect on keys is not declared makes the
model be evaluated whole and compared, so no change is ever missed.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.changes import FEW, Changes, Keys, compared, delta_of, few, keys_frame, nullable
from docweave.errors import (
    DependencyUnresolved,
    DuplicateKey,
    EngineError,
    LockConflict,
    MetadataNotFound,
    ModelAlreadyExists,
    PropagationDepthExceeded,
    RequiredColumnMissing,
    TypeMismatch,
)
from docweave.functions.naming import ModelSchema, checked_identifier, classify, ctas_header, ctas_namespace
from docweave.plans import graph, lineage
from docweave.sources.store import Files, Manifest, Versioned, workspace, write_root

#: Batch ids that the manifest names itself; older ones are in ledgers that it points to.
LEDGER = 1_000


@dataclass(frozen=True)
class Config:
    dependency_depth: int = 10
    propagation_iterations: int = 100
    prepared_hours: int = 24
    strict_id: bool = False
    metrics: bool = True
    #: A table's deltas become a new root once they are over this share of it and this many rows.
    compact_share: float = 0.1
    compact_rows: int = 100_000
    smart_patch: bool = True


@dataclass(frozen=True)
class Base:
    """A base table: the entity it stores, its key, and which entities its foreign keys name."""

    name: str
    entity: str
    pk: str
    fks: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    """A read model. ``children``: base tables (or ``v_`` models) gathered into a row, by the column that holds its
    key. ``whole``: sources whose changes reach keys in no declared way; they make it be evaluated whole."""

    name: str
    entity: str
    pk: str
    select: str
    base: str
    schema: ModelSchema
    fks: dict[str, str]
    children: dict[str, str]
    sources: tuple[str, ...]
    kinds: dict[str, tuple[str, str | None]]
    created_at: str
    whole: tuple[str, ...] = ()
    namespace: str = "public"


@dataclass
class Metrics:
    refreshed: int = 0
    rewritten: int = 0
    removed: int = 0
    patched: int = 0
    whole: int = 0
    batches: int = 0
    commits: int = 0
    graph_hits: int = 0
    graph_misses: int = 0
    seconds: float = 0.0

    def as_dict(self) -> dict:
        looked = self.graph_hits + self.graph_misses
        return {**asdict(self), "graph_hit_rate": self.graph_hits / looked if looked else 0.0, "mean_seconds": self.seconds / self.commits if self.commits else 0.0}


class Frames(Mapping):
    """What a definition can read, made when it is read: base tables, and each model as ``v_<entity>`` and by
    its own name, with or without its namespace."""

    def __init__(self, engine: Engine, tables: dict[str, Versioned], instead: dict[str, DataFrame] | None = None):
        self.e, self.tables, self.instead = engine, tables, instead or {}
        self.names = {n: n for n in engine.bases}
        for m in engine.models.values():
            if m.name in tables:
                for n in (f"v_{m.entity}", m.name):
                    self.names[n] = self.names[f"{m.namespace}.{n}"] = m.name

    def __getitem__(self, name: str) -> DataFrame:
        return self.instead[name] if name in self.instead else self.e.table(self.names[name], self.tables)

    def __contains__(self, name) -> bool:
        return name in self.names or name in self.instead

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, config: Config = Config()):
        self.spark, self.config = spark, config
        self.path = path or workspace(spark)
        self.files = Files(spark, self.path)
        self.manifest = Manifest(self.files)
        self.metrics = Metrics()
        self._order: list[str] | None = None
        self._read: dict[str, DataFrame] = {}
        self.version, state = self.manifest.load()
        self.tables: dict[str, Versioned] = {n: Versioned.from_dict(v) for n, v in state.get("tables", {}).items()}
        self.bases = {n: Base(**v) for n, v in state.get("bases", {}).items()}
        self.models = {n: Model(**{**v, "schema": ModelSchema(**{**v["schema"], "fks": tuple(v["schema"]["fks"]), "uuid_fks": tuple(v["schema"]["uuid_fks"])}), "sources": tuple(v["sources"]), "whole": tuple(v["whole"]), "kinds": {k: tuple(x) for k, x in v["kinds"].items()}}) for n, v in state.get("models", {}).items()}
        self.applied: list[str] = state.get("applied", [])
        self.ledgers: list[str] = state.get("ledgers", [])
        self._past: set[str] = {i for name in self.ledgers for i in self.files.read(name)["applied"]}

    # catalog -------------------------------------------------------------------------------------

    def _publish(self) -> None:
        if len(self.applied) > LEDGER:
            name = f"applied/{self.version + 1:012d}-{uuid.uuid4().hex}.json"
            self.files.create(name, {"applied": self.applied})
            self._past |= set(self.applied)
            self.ledgers, self.applied = [*self.ledgers, name], []
        state = {
            "tables": {n: v.as_dict() for n, v in self.tables.items()},
            "bases": {n: asdict(b) for n, b in self.bases.items()},
            "models": {n: asdict(m) for n, m in self.models.items()},
            "applied": self.applied,
            "ledgers": self.ledgers,
        }
        self.version = self.manifest.publish(self.version, state)

    def was_applied(self, batch_id: str) -> bool:
        return batch_id in self._past or batch_id in self.applied

    def _log(self, operation: str, name: str, **details) -> None:
        at = datetime.now(timezone.utc).isoformat()
        self.files.create(f"audit/{at.replace(':', '')}-{uuid.uuid4().hex}.json", {"operation": operation, "name": name, "at": at, "details": json.dumps(details)})

    @property
    def audit(self) -> list[dict]:
        """Creations, drops and refreshes so far, of all engines on this path."""
        return [self.files.read(f"audit/{n}") for n in self.files.names("audit") if n.endswith(".json")]

    def register(self, name: str, path: str, pk: str, entity: str | None = None, fks: dict[str, str] | None = None) -> None:
        """A Parquet table as a base table; its files stay where they are."""
        checked_identifier(name)
        self.bases[name] = Base(name, entity or name, pk, fks or {})
        self.tables[name] = Versioned.of(self.spark, name, pk, path, tuple(fks or {}))
        self._order = None

    def table(self, name: str, tables: dict[str, Versioned] | None = None) -> DataFrame:
        tables = self.tables if tables is None else tables
        if name not in tables:
            raise MetadataNotFound(name)
        return tables[name].current(self.spark)

    def exists(self, name: str) -> bool:
        return name in self.tables

    def key_type(self, name: str) -> T.DataType:
        t = self.tables[name]
        return t.struct[t.pk].dataType

    def _entity_of(self, relation: str) -> str | None:
        name = relation.split(".")[-1]
        if relation in self.bases:
            return self.bases[relation].entity
        return next((m.entity for m in self.models.values() if name in (m.name, f"v_{m.entity}")), None)

    def _model_of(self, relation: str) -> Model | None:
        name = relation.split(".")[-1]
        return None if relation in self.bases else next((m for m in self.models.values() if name in (m.name, f"v_{m.entity}")), None)

    def refers(self) -> dict[str, set[str]]:
        """Entities that each model's rows depend on: by foreign key, as gathered children, or read otherwise."""
        names, out = Frames(self, self.tables), {}
        for m in self.models.values():
            read = {x.entity for r in lineage.references(m.select, names) if (x := self._model_of(r.name)) is not None}
            out[m.entity] = set(m.fks.values()) | read
        return out

    def order(self) -> list[Model]:
        """Models, referenced ones first."""
        if self._order is None:
            self.metrics.graph_misses += 1
            self._order = graph.refresh_order(self.refers())
        else:
            self.metrics.graph_hits += 1
        by = {m.entity: m for m in self.models.values()}
        return [by[e] for e in self._order]

    def levels(self) -> list[list[Model]]:
        """The same by level: models of one level don't depend on each other."""
        refers, level = self.refers(), {}
        out: list[list[Model]] = []
        for m in self.order():
            level[m.entity] = 1 + max((level[r] for r in refers[m.entity] if r in level and r != m.entity), default=-1)
            while len(out) <= level[m.entity]:
                out.append([])
            out[level[m.entity]].append(m)
        return out

    # definition ----------------------------------------------------------------------------------

    def frames(self, tables: dict[str, Versioned] | None = None) -> Frames:
        return Frames(self, self.tables if tables is None else tables)

    def create(self, name: str, select: str, base: str, fks: dict[str, str] | None = None, children: dict[str, str] | None = None, namespace: str = "public", extra_sources: tuple[str, ...] = ()) -> str:
        """Defines, checks and fills a model. ``base``: the table that gives it one row a key; ``fks``: output
        ``fk_`` columns by entity (default: by name), which hold the key of what they name; ``children``:
        gathered tables by their key column. What a select reads besides makes it be evaluated whole."""
        checked_identifier(name, ("tv_",))
        if name in self.models:
            raise ModelAlreadyExists(name)
        frames = self.frames()
        missing = [r for r in lineage.relations(self.spark, select) if r not in frames]
        if missing or base not in frames:
            raise DependencyUnresolved(", ".join(missing or [base]))
        view = lineage.bound(self.spark, select, frames)
        schema = classify(view.schema, self.config.strict_id)
        if schema.pk is None:
            view, select = self._raw(name, select, view)
            schema = classify(view.schema, self.config.strict_id)
        if schema.data is None:
            raise RequiredColumnMissing("column data is missing")
        if any(m.entity == schema.entity for m in self.models.values()):
            raise ModelAlreadyExists(f"entity {schema.entity}")
        views = {f"v_{m.entity}": m.select for m in self.models.values()} | {m.name: m.select for m in self.models.values()} | {f"v_{schema.entity}": select}
        views |= {f"{m.namespace}.{n}": m.select for m in self.models.values() for n in (f"v_{m.entity}", m.name)}
        sources = lineage.base_tables(self.spark, f"v_{schema.entity}", views, self.config.dependency_depth)
        fks = {c: c[3:] for c in schema.fks} | (fks or {})
        kinds = {c: tuple(map(lambda x: str(x) if x else None, lineage.kind_of(select, c))) for c in fks}
        model = Model(name, schema.entity, schema.pk, select, base, schema, fks, children or {}, tuple(sorted({*sources, *extra_sources})), kinds, datetime.now(timezone.utc).isoformat(), (), namespace)
        model = Model(**{**model.__dict__, "whole": tuple(sorted({*self._uncovered(model), *extra_sources}))})
        self.models[name] = model
        self._order = None
        try:
            graph.refresh_order(self.refers())
            self._fill(model)
        except EngineError:
            del self.models[name]
            self._order = None
            raise
        self._publish()
        self._log("CREATE", name)
        return f"model {name} created"

    def _uncovered(self, model: Model) -> set[str]:
        """Relations read more often than keys follow from: once as the base, once for each gathering and foreign key."""
        count: dict[str, int] = {}
        for r in lineage.references(model.select, self.frames()):
            count[r.name] = count.get(r.name, 0) + 1
        out = set()
        for name, n in count.items():
            ways = (name == model.base) + (name in model.children) + sum(e == self._entity_of(name) for e in model.fks.values())
            if n > ways:
                out.add(name)
        return out

    def _raw(self, name: str, select: str, view: DataFrame) -> tuple[DataFrame, str]:
        """A SELECT without a key column: key from ``id`` or the first integer column, a stable id, all columns as the document."""
        entity = name[3:]
        key = "id" if "id" in view.columns else next((f.name for f in view.schema if f.dataType.typeName() in ("long", "integer", "short")), None)
        if key is None:
            raise RequiredColumnMissing("no column can be the key")
        kind = "STRING" if view.schema[key].dataType.typeName() == "string" else "BIGINT"
        text = f"SELECT CAST(`{key}` AS {kind}) AS pk_{entity}, md5(concat('{entity}:', CAST(`{key}` AS STRING))) AS id, struct(*) AS data FROM ({select}) raw_"
        return lineage.bound(self.spark, text, self.frames()), text

    def _stamped(self, df: DataFrame, at: str) -> DataFrame:
        return df.withColumn("updated_at", F.lit(at).cast("timestamp")).withColumn("created_at", F.lit(at).cast("timestamp"))

    def _fill(self, model: Model) -> None:
        frames = Frames(self, {n: t for n, t in self.tables.items() if n != model.name})
        at = datetime.now(timezone.utc).isoformat()
        rows = self._stamped(lineage.bound(self.spark, model.select, frames), at)
        path = f"{self.path}/{model.name}-{uuid.uuid4().hex}"
        filters = tuple(c for c in (model.schema.id, *model.fks, *model.schema.uuid_fks) if c in rows.columns)
        write_root(rows, path, model.pk, filters)
        made = Versioned.of(self.spark, model.name, model.pk, path, filters)
        read = self.spark.read.schema(made.struct).parquet(path)
        twice = read.groupBy(model.pk).count().where("count > 1").limit(1).collect()
        if twice:
            raise DuplicateKey(f"{model.name}: key {twice[0][0]} has {twice[0][1]} rows")
        self.tables[model.name] = replace(made, filled=at)

    def convert(self, name: str, path: str, select: str | None = None, base: str | None = None, comment: str = "", **given) -> str:
        """An existing Parquet table becomes a model. It needs ``id`` and ``data``. With a select, its rows are
        replaced by the definition's; without one they are kept, as the base table ``<name>_rows`` that gives
        them, and the tables they seem to come from (``infer_bases``) are recorded as sources."""
        old = self.spark.read.parquet(path)
        for column in ("id", "data"):
            if column not in old.columns:
                raise RequiredColumnMissing(f"column {column} is missing")
        if old.schema["data"].dataType.typeName() not in ("struct", "string", "variant") or old.schema["id"].dataType.typeName() not in ("string", "long", "integer"):
            raise TypeMismatch("id must be a text or integer key and data a document")
        found = tuple(self.infer_bases(path, comment))
        if select is not None:
            return self.create(name, select, base or next((b for b in found), ""), extra_sources=found, **given)
        pk = next((c for c in old.columns if c.startswith("pk_")), None)
        self.register(f"{name}_rows", path, pk or "id", f"{name[3:]}_rows")
        columns = ", ".join(f"`{c}`" for c in old.columns if c not in ("created_at", "updated_at"))
        key = "" if pk else f"`id` AS pk_{name[3:]}, "
        return self.create(name, f"SELECT {key}{columns} FROM {name}_rows", f"{name}_rows", extra_sources=found, **given)

    def infer_bases(self, path: str, comment: str = "", most: int = 5) -> list[str]:
        """Base tables of a stored model: those that its comment names (``TVIEW_BASES: a, b``), else those whose
        ``fk_<entity>`` or ``<entity>_id`` is a column or a key in the documents of a few rows."""
        named = re.search(r"TVIEW_BASES\s*:\s*([\w ,]+)", comment)
        if named:
            return [t for t in (x.strip() for x in named[1].split(",")) if t in self.bases]
        old = self.spark.read.parquet(path)
        keys = set(old.columns)

        def walk(value) -> None:
            for k, v in value.items() if isinstance(value, dict) else ():
                keys.add(k)
                walk(v)
            for v in value if isinstance(value, list) else ():
                walk(v)

        data = F.col("data") if old.schema["data"].dataType.typeName() == "string" else F.to_json("data")
        for row in old.select(data.alias("d")).where("d IS NOT NULL").limit(most).collect():
            walk(json.loads(row.d))
        entities = {k[3:] for k in keys if k.startswith("fk_")} | {k[:-3] for k in keys if k.endswith("_id")}
        return sorted(b.name for b in self.bases.values() if b.entity in entities or b.name in {f"tb_{e}" for e in entities})

    def sql(self, text: str, base: str | None = None, **given):
        """``CREATE TABLE tv_x AS SELECT``, ``DROP TABLE [IF EXISTS] tv_x``; anything else is a query over the frames."""
        header = ctas_header(text)
        if header:
            name, select = header
            return self.create(name, select, base or next(r.name for r in lineage.references(select, self.frames()) if r.name in self.bases), namespace=ctas_namespace(text) or "public", **given)
        words = text.strip().rstrip(";").replace(",", " ").split()
        if [w.upper() for w in words[:2]] == ["DROP", "TABLE"]:
            known = [w.split(".")[-1] for w in words[2:] if w.split(".")[-1].startswith("tv_")]
            return [self.drop(n, "EXISTS" in map(str.upper, words), "CASCADE" in map(str.upper, words)) for n in known]
        return lineage.bound(self.spark, text, self.frames())

    def drop(self, name: str, if_exists: bool = False, cascade: bool = False) -> str:
        if name not in self.models:
            if if_exists:
                return f"model {name} does not exist"
            raise MetadataNotFound(name)
        entity = self.models[name].entity
        users = [m.name for m in self.models.values() if entity in self.refers()[m.entity] and m.name != name]
        if users and not cascade:
            raise EngineError(f"{name} is used by {', '.join(users)}")
        for u in users:
            if u in self.models:
                self.drop(u, True, True)
        del self.models[name]
        del self.tables[name]
        self._order = None
        self._publish()
        self._log("DROP", name)
        return f"model {name} dropped"

    def vacuum(self) -> int:
        """Deletes this engine's table files that the published state doesn't name; no reader of an older state
        may be left. Returns how many."""
        used = {p.rstrip("/").split("/")[-1] for t in self.tables.values() for p in (t.root, *(d.path for d in t.deltas))}
        used |= {c["path"].split("/")[-1] for p in self.prepared() for c in p["changes"]}
        kept = {"manifest", "pending", "audit", "applied", "metrics", "locks"} | {t.root.rstrip("/").split("/")[-1] for t in self.tables.values()}
        gone = [n for n in self.files.names("") if n not in used | kept and re.search(r"-[0-9a-f]{32}$", n)]
        for n in gone:
            self.files.delete(n)
        return len(gone)

    # changes -------------------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self)

    def apply(self, batch: Callable[[Transaction], None], batch_id: str | None = None) -> dict:
        """One transaction; a batch id that was applied before is a no-op."""
        if batch_id is not None and self.was_applied(batch_id):
            return {"skipped": batch_id}
        t = self.begin()
        batch(t)
        return t.commit(batch_id)

    def cascade(self, table: str, where: str | Column) -> dict:
        """Refreshes what rows of a base table reach, as if they had changed."""
        return self.apply(lambda t: t.touch(table, where))

    def reload(self) -> None:
        """The published state as it is now."""
        self.__init__(self.spark, self.path, self.config)

    def apply_retrying(self, batch: Callable[[Transaction], None], batch_id: str | None = None, tries: int = 3, wait: float = 0.01) -> dict:
        """``apply``; after a conflict with another writer, again on its state, waiting twice as long each time."""
        for k in range(tries):
            try:
                return self.apply(batch, batch_id)
            except LockConflict:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
                self.reload()
        return {}

    def view(self, name: str, tables: dict[str, Versioned] | None = None) -> DataFrame:
        """The defining query, evaluated whole: the truth that the stored model must equal."""
        return lineage.bound(self.spark, self.models[name].select, self.frames(tables))

    def refresh(self, name: str, cascade: bool = True) -> list[str]:
        """Full refresh, then of the models that embed it (``cascade``). Names what was refreshed."""
        if name not in self.models:
            raise MetadataNotFound(name)
        refers, stale = self.refers(), {self.models[name].entity}
        names = []
        for m in self.order():
            if m.name == name or (cascade and refers[m.entity] & stale):
                stale.add(m.entity)
                self._fill(m)
                names.append(m.name)
        self._publish()
        self._log("REFRESH", name, refreshed=names)
        return names

    def refresh_all(self, pattern: str = "%") -> list[str]:
        like = re.compile(re.escape(pattern).replace("%", ".*").replace("_", "."))
        names = [m.name for m in self.order() if like.fullmatch(m.name)]
        for n in names:
            self.refresh(n, cascade=False)
        return names

    def compact(self) -> None:
        self.tables = {n: t.compacted(self.spark, self.path, self.config.compact_share) for n, t in self.tables.items()}
        self._publish()

    # prepared transactions -----------------------------------------------------------------------

    def prepared(self) -> list[dict]:
        return [p for n in self.files.names("pending") if n.endswith(".json") and (p := self.files.read(f"pending/{n}"))]

    def commit_prepared(self, gid: str) -> dict:
        """Commits what was prepared under ``gid``, once: a repetition after a crash is a no-op. Rows that were
        changed since by others are a conflict, and nothing is committed."""
        kept = self.files.read(f"pending/{checked_identifier(gid)}.json")
        if kept is None:
            return {"gid": gid, "status": "unknown"}
        # by its own mark, so that the id can be used again
        mark = f"prepared:{gid}:{kept['mark']}"
        done: dict = {}
        if not self.was_applied(mark):
            t = Transaction(self)
            for change in kept["changes"]:
                rows = Changes.read(self.spark, change["path"])
                t.check_unchanged(change["table"], rows)
                t._add(change["table"], rows)
            done = t.commit(mark)
        self.files.delete(f"pending/{gid}.json")
        return {"gid": gid, "status": "processed", **done}

    def rollback_prepared(self, gid: str) -> bool:
        kept = self.files.read(f"pending/{checked_identifier(gid)}.json")
        self.files.delete(f"pending/{gid}.json")
        return kept is not None

    def recover_prepared(self, older_seconds: float = 3600, now: float | None = None, lock_seconds: float = 3600) -> list[tuple[str, int, str]]:
        """Commits what was prepared longer ago: (gid, changed keys, status). One process at a time; the others
        get an empty list. A lock older than ``lock_seconds`` is that of a dead process."""
        now = time.time() if now is None else now
        held = self.files.read("locks/recover.json")
        if held and time.time() - held["at"] > lock_seconds:
            self.files.delete("locks/recover.json")
        if not self.files.create("locks/recover.json", {"at": time.time()}):
            return []
        try:
            out = []
            for p in self.prepared():
                if now - p["at"] >= older_seconds:
                    try:
                        self.commit_prepared(p["gid"])
                        out.append((p["gid"], p["keys"], "processed"))
                    except EngineError as e:
                        out.append((p["gid"], p["keys"], f"error: {e}"))
            return out
        finally:
            self.files.delete("locks/recover.json")

    def cleanup_expired(self, now: float | None = None) -> int:
        now = time.time() if now is None else now
        old = [p["gid"] for p in self.prepared() if now - p["at"] > 3600 * self.config.prepared_hours]
        return sum(self.rollback_prepared(g) for g in old)


@dataclass
class Reach:
    """What changes reach of a model: keys, found when they are asked for (None: possibly all of it), and the one
    foreign key by which all came, with its changed values."""

    find: Callable[[], Keys] | None
    by: str | None = None
    values: Keys | None = None
    none: bool = False
    _keys: Keys | None = None

    @property
    def whole(self) -> bool:
        return self.find is None

    @property
    def keys(self) -> Keys:
        if self._keys is None:
            self._keys = self.find()
        return self._keys


@dataclass
class Rebuilt:
    """A model with a new root in which ``n`` rows are others."""

    table: Versioned
    n: int


class Transaction:
    """Changes since ``begin``: nothing is published before ``commit``; savepoints are cheap, tables are immutable."""

    def __init__(self, engine: Engine):
        self.e, self.spark = engine, engine.spark
        self.tables = dict(engine.tables)
        self.changes: list[tuple[str, Changes]] = []
        self.savepoints: list[tuple[str, dict, int]] = []
        #: How each model was refreshed by the last commit: none, patch, keys or whole.
        self.strategies: dict[str, str] = {}

    def _add(self, table: str, rows: Changes) -> None:
        """One change: rows of (pk, before struct, after struct)."""
        t = self.tables[table]
        if rows.n:
            self.tables[table] = t.with_delta(delta_of(rows, t), rows.n)
        self.changes.append((table, rows))

    def _now(self, table: str) -> DataFrame:
        if table not in self.e.bases:
            raise MetadataNotFound(table)
        return self.e.table(table, self.tables)

    def _found(self, df: DataFrame, table: str) -> Changes:
        return Changes.of(df, self.e.path, f"change-{table}")

    def update(self, table: str, where: str | Column, values: dict[str, Column | str]) -> Transaction:
        """Rows of the predicate with new values; rows that stay as they are do not count as changed."""
        rows = self._now(table)
        pk = self.e.bases[table].pk
        if pk in values:
            raise EngineError(f"{pk} is the key of {table}: delete and insert instead")
        types = {f.name: f.dataType for f in rows.schema}
        hit = rows.where(where)
        set_ = {c: (F.expr(v) if isinstance(v, str) else v).cast(types[c]) for c, v in values.items()}
        after = F.struct(*[set_[c].alias(c) if c in set_ else F.col(c) for c in rows.columns])
        both = hit.select(F.col(pk).alias("pk"), F.struct(*rows.columns).alias("before"), after.alias("after"))
        self._add(table, self._found(both.where(~F.col("before").eqNullSafe(F.col("after"))), table))
        return self

    def insert(self, table: str, rows: DataFrame) -> Transaction:
        """New rows; one whose key exists replaces it. A key that the rows have twice is an error."""
        now = self._now(table)
        pk, struct = self.e.bases[table].pk, now.schema
        new = self._found(rows.select(F.col(pk).cast(struct[pk].dataType).alias("pk"), F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct]).alias("after")), table)
        keys = new.values("pk")
        if (len(set(keys)) if keys is not None else new.frame.select("pk").distinct().count()) != new.n:
            raise DuplicateKey(f"{table}: a key is inserted twice")
        of = Keys.of(self.spark, set(keys), struct[pk].dataType) if keys is not None else Keys(new.frame.select(F.col("pk").alias("k")), new.n)
        old = of.within(now, pk).select(F.col(pk).alias("pk"), F.struct(*now.columns).alias("before"))
        both = new.frame.join(old, "pk", "left").select("pk", "before", "after")
        self._add(table, Changes.of(both.where(~F.col("before").eqNullSafe(F.col("after"))), self.e.path, f"change-{table}", new.n > FEW))
        return self

    def _deleted(self, hit: DataFrame, table: str) -> Transaction:
        hit = hit.select(F.col(self.e.bases[table].pk).alias("pk"), F.struct(*hit.columns).alias("before"))
        self._add(table, self._found(hit.withColumn("after", F.lit(None).cast(hit.schema["before"].dataType)), table))
        return self

    def delete(self, table: str, where: str | Column) -> Transaction:
        return self._deleted(self._now(table).where(where), table)

    def delete_keys(self, table: str, keys: DataFrame) -> Transaction:
        """Deletes the rows whose key is in the first column of ``keys``."""
        return self._deleted(Keys.among(keys.select(F.col(keys.columns[0]).cast(self.e.key_type(table)).alias("k")).distinct(), self.e.path).within(self._now(table), self.e.bases[table].pk), table)

    def touch(self, table: str, where: str | Column) -> Transaction:
        """Marks rows as changed without changing them."""
        rows = self._now(table).where(where)
        row = F.struct(*rows.columns)
        found = self._found(rows.select(F.col(self.e.bases[table].pk).alias("pk"), row.alias("before"), row.alias("after")), table)
        self.changes.append((table, found))
        return self

    def savepoint(self, name: str) -> Transaction:
        self.savepoints.append((name, dict(self.tables), len(self.changes)))
        return self

    def rollback_to(self, name: str) -> Transaction:
        """Drops what came after the savepoint; the savepoint itself stays."""
        at = max(i for i, s in enumerate(self.savepoints) if s[0] == name)
        _, tables, n = self.savepoints[at]
        self.tables, self.changes, self.savepoints = dict(tables), self.changes[:n], self.savepoints[: at + 1]
        return self

    def release(self, name: str) -> Transaction:
        at = max(i for i, s in enumerate(self.savepoints) if s[0] == name)
        self.savepoints = self.savepoints[:at]
        return self

    def abort(self) -> None:
        self.tables, self.changes, self.savepoints = dict(self.e.tables), [], []

    def prepare(self, gid: str) -> None:
        """Keeps the changes for a later ``commit_prepared``, by any engine on this path."""
        changes = [{"table": t, "path": c.kept(self.e.path, f"change-{t}")} for t, c in self.changes]
        kept = {"gid": gid, "version": 1, "at": time.time(), "mark": uuid.uuid4().hex, "keys": sum(c.n for _, c in self.changes), "changes": changes}
        if not self.e.files.create(f"pending/{checked_identifier(gid)}.json", kept):
            raise ModelAlreadyExists(f"prepared transaction {gid}")
        self.abort()

    def check_unchanged(self, table: str, rows: Changes) -> None:
        """Raises unless every changed row is still as it was before the change."""
        now = self._now(table)
        pk = self.e.bases[table].pk
        here = Keys(rows.frame.select(F.col("pk").alias("k")), rows.n).within(now, pk).select(F.col(pk).alias("pk"), F.struct(*now.columns).alias("now"))
        other = rows.frame.join(here, "pk", "left").where(~F.col("before").eqNullSafe(F.col("now"))).select("pk").limit(1).collect()
        if other:
            raise LockConflict(f"{table}: row {other[0][0]} was changed since the transaction was prepared")

    # refresh -------------------------------------------------------------------------------------

    def _changed(self) -> dict[str, list[Changes]]:
        out: dict[str, list[Changes]] = {}
        for table, rows in self.changes:
            out.setdefault(table, []).append(rows)
        return out

    def affected(self, model: Model, changed: dict[str, list[Changes]], refreshed: dict[str, Changes]) -> Reach | None:
        """What changes reach of the model: its own rows, rows that hold a changed foreign key, the rows that
        changed children belonged to before or belong to now, or, by an undeclared source, any."""
        e = self.e

        def of(relation: str) -> list[Changes]:
            m = e._model_of(relation)
            return changed.get(relation, []) if m is None else [refreshed[m.entity]] if m.entity in refreshed else []

        if any(c.n for name in model.whole for c in of(name)):
            return Reach(None)
        key = e.key_type(model.name)
        local: set = set()
        plans: list[DataFrame] = []
        ways: set[str] = set()
        touched = False

        def add(rows: Changes, path: str) -> None:
            values = rows.values(path)
            if values is None:
                plans.append(rows.frame.select(F.col(path).cast(key).alias("k")))
            else:
                local.update(v for v in values if v is not None)

        read = list(dict.fromkeys(r.name for r in lineage.references(model.select, e.frames())))
        for rows in of(model.base):
            touched = True
            if rows.n:
                ways.add("")
                add(rows, "pk")
        for child, column in model.children.items():
            for rows in of(child):
                touched = True
                if rows.n:
                    ways.add("")
                    add(rows, f"before.{column}")
                    add(rows, f"after.{column}")
        stored = None
        of_fk = None
        for fk, entity in model.fks.items():
            for relation in read:
                if relation == model.base and entity != e._entity_of(model.base):
                    continue
                for rows in of(relation) if e._entity_of(relation) == entity else ():
                    touched = True
                    if not rows.n:
                        continue
                    ways.add(fk)
                    stored = e.table(model.name, self.tables) if stored is None else stored
                    values = rows.values("pk")
                    of_fk = Keys.of(self.spark, set(values), stored.schema[fk].dataType) if values is not None else Keys(rows.frame.select(F.col("pk").alias("k")).distinct(), rows.n)
                    plans.append(of_fk.within(stored.select(fk, model.pk), fk).select(F.col(model.pk).alias("k")))
        if not touched:
            return None

        def rows_of(values: set) -> DataFrame:
            return keys_frame(self.spark, values, key)

        def find() -> Keys:
            if not plans:
                return Keys.of(self.spark, local, key) if len(local) <= FEW else Keys.among(rows_of(local), e.path)
            out = None
            for p in plans if not local else [*plans, rows_of(local)]:
                out = p if out is None else out.union(p)
            return Keys.among(out.where("k IS NOT NULL").distinct(), e.path)

        by = next(iter(ways)) if len(ways) == 1 and len(plans) == 1 else None
        return Reach(find, by or None, of_fk if by else None, not plans and not local)

    def affected_keys(self, name: str) -> DataFrame:
        """The keys (k) of a model that the open transaction's changes of base tables reach directly."""
        model = self.e.models[name]
        reach = self.affected(model, self._changed(), {})
        if reach is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("k", self.e.key_type(name))]))
        return self.e.table(name, self.tables).select(F.col(model.pk).alias("k")) if reach.whole else reach.keys.frame

    def restricted(self, model: Model, keys: Keys) -> DataFrame:
        """The defining query for some keys. They reduce the reading of the base that gives the rows, and every
        gathered child before its aggregate; readings in any other role stay whole."""
        frames = self.e.frames(self.tables)
        refs = lineage.references(model.select, frames)
        instead: dict[int, DataFrame] = {}
        base_pk = self.e.bases[model.base].pk if model.base in self.e.bases else self.e._model_of(model.base).pk
        giver = lineage.row_giver(model.select, refs, model.base, base_pk, model.pk)
        if giver is not None:
            instead[giver] = keys.within(frames[model.base], base_pk)
        for child, column in model.children.items():
            mine = [i for i, r in enumerate(refs) if r.name == child]
            if len(mine) == 1:
                instead[mine[0]] = keys.within(frames[child], column)
        return keys.within(lineage.bound(self.spark, model.select, frames, instead), model.pk)

    def _patch(self, model: Model, reach: Reach, refreshed: dict[str, Changes]) -> DataFrame | None:
        """Changed rows by putting new embedded documents in place of old ones; None where that isn't all there is to it."""
        e, entity = self.e, model.fks.get(reach.by or "")
        if not e.config.smart_patch or reach.values is None or entity not in refreshed or model.kinds.get(reach.by, ("",))[0] != lineage.Kind.NESTED:
            return None
        name, rows = lineage.embedded(model.select, f"v_{entity}"), refreshed[entity]
        stored = self.e.table(model.name, self.tables)
        data, new = stored.schema["data"].dataType, rows.frame.schema["after"].dataType["data"].dataType
        if name is None or not isinstance(data, T.StructType) or name not in data.names or data[name].dataType != new:
            return None
        columns = [c for c in stored.columns if c not in ("created_at", "updated_at")]
        # a removed row's document is null, as the join from the left has it
        docs = rows.frame.select(F.col("pk").alias("_f"), F.col("after.data").alias("_d"))
        hit = reach.values.within(stored, reach.by).join(F.broadcast(docs) if rows.n <= FEW else docs, F.col(reach.by) == F.col("_f"))
        after = F.struct(*[F.struct(*[F.col("_d").alias(f) if f == name else F.col("data")[f].alias(f) for f in data.names]).alias("data") if c == "data" else F.col(c) for c in columns])
        return hit.select(F.col(model.pk).alias("pk"), F.struct(*columns).alias("before"), after.alias("after"), "created_at")

    def _rebuilt(self, model: Model, reach: Reach, refreshed: dict[str, Changes], at: datetime) -> Rebuilt | None:
        """The model patched into a new root, where so many embedded documents changed that its delta would be folded
        into one at once: rows are moved once instead of three times, and no images are written. Only for models
        that no other reads, as those would need the images; None where it doesn't apply."""
        e, entity = self.e, model.fks.get(reach.by or "")
        if not e.config.smart_patch or reach.values is None or entity not in refreshed or model.kinds.get(reach.by, ("",))[0] != lineage.Kind.NESTED:
            return None
        rows, t, source = refreshed[entity], self.tables[model.name], self.tables[next(m.name for m in e.models.values() if m.entity == entity)]
        if rows.rows is not None or any(model.entity in r for n, r in e.refers().items() if n != model.entity) or rows.frame.where("before IS NULL OR after IS NULL").limit(1).collect():
            return None
        name = lineage.embedded(model.select, f"v_{entity}", inner=True)
        data, new = t.struct["data"].dataType, rows.frame.schema["after"].dataType["data"].dataType
        if name is None or not isinstance(data, T.StructType) or name not in data.names or nullable(data[name].dataType) != nullable(new):
            return None
        n, of = (self.spark.read.schema(x.struct).parquet(x.root).count() for x in (t, source))
        if n * rows.n <= of * max(e.config.compact_rows, e.config.compact_share * n):
            return None
        when = F.lit(at).cast("timestamp")
        docs = rows.frame.where(~F.col("before.data").eqNullSafe(F.col("after.data"))).select(F.col("pk").alias("_f"), F.col("after.data").alias("_d"))
        if t.filled is not None and not t.deltas:
            # all rows are as old: the definition gives them with less to move than the stored ones
            made = F.lit(t.filled).cast("timestamp")
            both = e.view(model.name, self.tables).join(docs.select("_f"), F.col(reach.by) == F.col("_f"), "left").withColumn("created_at", made).withColumn("updated_at", F.when(F.col("_f").isNotNull(), when).otherwise(made))
        else:
            both = e.table(model.name, self.tables).join(docs, F.col(reach.by) == F.col("_f"), "left").withColumn("updated_at", F.when(F.col("_f").isNotNull(), when).otherwise(F.col("updated_at")))
            both = both.withColumn("data", F.struct(*[(F.when(F.col("_f").isNotNull(), F.col("_d")).otherwise(F.col("data")[f]) if f == name else F.col("data")[f]).alias(f) for f in data.names]))
        path = f"{e.path}/{model.name}-{uuid.uuid4().hex}"
        write_root(both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.struct]), path, model.pk, t.filters)
        changed = self.spark.read.schema(t.struct).parquet(path).where(F.col("updated_at") == when).count()
        return Rebuilt(Versioned(t.name, t.pk, path, t.schema, filters=t.filters), changed)

    def _refreshed(self, model: Model, reach: Reach, refreshed: dict[str, Changes], at: datetime) -> tuple[Changes | Rebuilt, str]:
        """The model's changed rows, with created_at of those that were there."""
        e = self.e
        rebuilt = self._rebuilt(model, reach, refreshed, at)
        if rebuilt is not None:
            return rebuilt, "patch"
        both = self._patch(model, reach, refreshed)
        if both is not None:
            found, how = Changes.of(both.where(~F.col("before").eqNullSafe(F.col("after"))), e.path, f"delta-{model.entity}"), "patch"
        else:
            old = e.table(model.name, self.tables)
            columns = [c for c in old.columns if c not in ("created_at", "updated_at")]
            if reach.whole:
                how, fresh = "whole", e.view(model.name, self.tables)
            else:
                how, old, fresh = "keys", reach.keys.within(old, model.pk), self.restricted(model, reach.keys)
            old = old.select(F.col(model.pk).alias("pk"), F.struct(*columns).alias("before"), "created_at")
            kinds = old.schema["before"].dataType
            fresh = fresh.select(F.col(model.pk).alias("pk"), F.struct(*[F.col(c).cast(kinds[c].dataType).alias(c) for c in columns]).alias("after"))
            found = self._differing(old, fresh, None if reach.whole else reach.keys.n, f"delta-{model.entity}")
        keys = found.values("pk")
        if (len(set(keys)) if keys is not None else found.frame.select("pk").distinct().count()) != found.n:
            raise DuplicateKey(model.name)
        return found, how

    def _differing(self, old: DataFrame, fresh: DataFrame, n: int | None, tag: str) -> Changes:
        """Rows that differ between what is stored and what should be; few keys are compared on the driver."""
        if n is not None and n <= FEW:
            with ThreadPoolExecutor(2) as pool:
                a, b = pool.map(few, (old, fresh))
            if a is not None and b is not None:
                schema = T.StructType([*a[1].fields[:2], b[1]["after"], a[1]["created_at"]])
                return Changes.local(self.spark, compared(a[0], b[0], schema), schema)
        both = old.join(fresh, "pk", "full_outer").select("pk", "before", "after", "created_at")
        return Changes.of(both.where(~F.col("before").eqNullSafe(F.col("after"))), self.e.path, tag, n is not None and n > FEW)

    def _one(self, model: Model, changed: dict[str, list[Changes]], refreshed: dict[str, Changes], at: datetime) -> tuple[Changes | Rebuilt | None, str] | None:
        reach = self.affected(model, changed, refreshed)
        if reach is None:
            return None
        if reach.none:
            return None, "none"
        return self._refreshed(model, reach, refreshed, at)

    def commit(self, batch_id: str | None = None) -> dict:
        begun = time.perf_counter()
        e = self.e
        changed = self._changed()
        refreshed: dict[str, Changes] = {}
        report: dict[str, dict] = {}
        at = datetime.now(timezone.utc)
        self.strategies = {}
        reached = 0
        with ThreadPoolExecutor(4) as pool:
            for models in e.levels():
                # models of one level are refreshed side by side
                found = dict(zip([m.name for m in models], pool.map(lambda m: self._one(m, changed, refreshed, at), models), strict=True))
                reached += any(f is not None and f[0] is not None and f[0].n for f in found.values())
                if reached > e.config.propagation_iterations:
                    raise PropagationDepthExceeded(f"changes reach more than {e.config.propagation_iterations} levels of models")
                for model in models:
                    if found[model.name] is None:
                        continue
                    rows, self.strategies[model.name] = found[model.name]
                    gone = 0
                    if isinstance(rows, Rebuilt):
                        self.tables[model.name] = rows.table
                    elif rows is not None and rows.n:
                        gone = rows.rows.column("after").null_count if rows.rows is not None else rows.frame.where("after IS NULL").count()
                        t = self.tables[model.name]
                        self.tables[model.name] = t.with_delta(delta_of(rows, t, at), rows.n)
                        refreshed[model.entity] = rows
                    report[model.name] = {"rewritten": (rows.n if rows is not None else 0) - gone, "removed": gone}
            # what the transaction changed is written, long chains of deltas folded, much of a table at once into its root
            def kept(t: Versioned) -> Versioned:
                if len(t.deltas) > 6 or t.changed() > e.config.compact_rows:
                    t = t.compacted(self.spark, e.path, e.config.compact_share, e.config.compact_rows)
                return t.written(self.spark, e.path)

            changed_tables = [n for n, t in self.tables.items() if any(d.path is None for d in t.deltas)]
            self.tables |= dict(zip(changed_tables, pool.map(lambda n: kept(self.tables[n]), changed_tables), strict=True))
        before, e.tables = e.tables, self.tables
        if batch_id is not None:
            e.applied.append(batch_id)
        try:
            e._publish()
        except EngineError:
            e.tables = before
            if batch_id is not None and batch_id in e.applied:
                e.applied.remove(batch_id)
            raise
        if e.config.metrics:
            for name, r in report.items():
                e.metrics.refreshed += 1
                e.metrics.rewritten += r["rewritten"]
                e.metrics.removed += r["removed"]
                e.metrics.patched += self.strategies[name] == "patch"
                e.metrics.whole += self.strategies[name] == "whole"
            e.metrics.batches += 1
            e.metrics.commits += 1
            e.metrics.seconds += time.perf_counter() - begun
        self.changes, self.savepoints, self.tables = [], [], dict(e.tables)
        return report
