"""Snapshots of a model as Parquet folders.

Every write goes to a folder of its own, so nothing that was published is ever written again. The manifest of a version names the
folders of its tables, and a small file named by the version points to the manifest. That file is created only if it is not there
(`sources.claims`), so of two publishers of a version one wins and the other gets an error and leaves nothing behind.

A version writes what differs from the one before and shares the rest:

* marks have a folder for each session, the tables of a standing one for each bucket of members: those that a batch touches are written;
* deleted rows are named by their keys, in a folder of keys ("dead") that takes rows away from all folders written before it; a
  changed member is a dead key and a new row. `compact` writes such tables whole again.

Folders carry the version of the schema they were written with; older ones are brought up to the present one when they are read
(`operators.migrations`). What is written is checked against the rules of the schema before it is published (`operators.quality`).
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.model import Model, Standing, schemas, standing_schemas
from rollcall.operators import quality
from rollcall.operators.migrations import SCHEMA_VERSION, columns_of, upgrade
from rollcall.operators.outcome import Outcome
from rollcall.sources import claims
from rollcall.sources.lineage import cut_lineage, remove, scope, spread

#: part: the session or bucket of a folder, null for a table in one folder. rows: of the whole write. written: the version that wrote
#: the folder. schema: of its rows. keys: of a folder of dead keys, the columns by which rows are gone; null for a folder of rows.
_MANIFEST = "version long, table string, part string, path string, rows long, written long, schema int, keys string"

#: Facts are laid out by session, so that a date filter on the sessions prunes their files; standings by bucket of members.
PARTITIONS = {
    "marks": "session_id", "stage2_marks": "session_id", **{f"standing_{name}": "bucket" for name in standing_schemas()},
}


#: Rules as (table, rule).
Rules = Collection[tuple[str, str]]


class ConstraintError(ValueError):
    """What was to be published breaks rules; `violations` has (table, rule, number of rows)."""

    def __init__(self, violations: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{table}: {rule} ({n})" for table, rule, n in violations))
        self.violations = violations


@dataclass(frozen=True)
class Version:
    """What a version's file says: its manifest, the standing's parameters, and how far a feed is folded in."""

    version: int
    manifest: str
    buckets: int | None = None
    recent_n: int | None = None
    feed_batch: int | None = None
    feed_open: str | None = None


def table_schemas(member_id: T.DataType = T.StringType()) -> dict[str, T.StructType]:
    """Schemas of all stored tables, those of a standing included."""
    return {**schemas(member_id), **{f"standing_{name}": schema for name, schema in standing_schemas(member_id).items()}}


def stored_tables(model: Model) -> dict[str, DataFrame]:
    own = {} if model.standing is None else {f"standing_{name}": table for name, table in model.standing.tables().items()}
    return {**model.tables(), **own}


def _base(root: str, name: str) -> str:
    return f"{root}/tables/{name}"


def feed_folder(root: str) -> str:
    """A new folder for what a version has left open of a feed."""
    return f"{root}/feed/{uuid.uuid4().hex}"


# --- versions -----------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> list[int]:
    """Those that can be read. A claim of no bytes is one whose publisher died: nothing is there, but its number is used up."""
    found = claims.names(spark, f"{root}/versions", empty=False)
    return sorted(int(name.removesuffix(".json")) for name in found if name.endswith(".json"))


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int:
    found = [v for v in versions(spark, root) if before is None or v < before]
    if not found:
        raise FileNotFoundError(f"no snapshot under {root}")
    return found[-1]


def read_version(spark: SparkSession, root: str, version: int) -> Version:
    return Version(**claims.read(spark, f"{root}/versions/{version}.json"))


def read_lines(spark: SparkSession, at: Version) -> list[Row]:
    """The lines of a version's manifest: a few for each session and bucket of members."""
    return spark.read.schema(_MANIFEST).parquet(at.manifest).collect()


def _observed(seen: Observation) -> dict[str, int]:
    """What was counted; Spark leaves the counting out of a plan that it knows to give no rows."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _refuse_existing(spark: SparkSession, root: str, version: int) -> None:
    if version in versions(spark, root):
        raise FileExistsError(f"version {version} under {root} is published")


# --- writing ------------------------------------------------------------------------------


@dataclass
class _Publication:
    """A version in the making: the folders written so far, and what they replace of the version before."""

    spark: SparkSession
    root: str
    version: int
    lines: list[Row] = field(default_factory=list)
    #: Tables written whole, and by table the parts written anew.
    whole: set[str] = field(default_factory=set)
    parts: dict[str, set[str]] = field(default_factory=dict)
    violations: list[tuple[str, str, int]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def _folder(self, name: str) -> str:
        self.folders.append(f"{_base(self.root, name)}/write={uuid.uuid4().hex}")
        return self.folders[-1]

    def _line(self, name: str, part: str | None, path: str, rows: int, schema: int, keys: str | None = None) -> None:
        self.lines.append(Row(
            version=self.version, table=name, part=part, path=path, rows=rows, written=self.version, schema=schema, keys=keys
        ))

    def rows(self, name: str, rows: DataFrame, schema: int = SCHEMA_VERSION) -> None:
        """Write rows of a table to a folder of their own, a part of it for each value of its partition."""
        by, seen, path = PARTITIONS.get(name), Observation(), self._folder(name)
        metrics = quality.row_metrics(name) if schema == SCHEMA_VERSION and name in schemas() else {}
        observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(rule) for rule, m in metrics.items()])
        # even files, and one writer per part unless that is too large for one
        observed.hint("rebalance", *([by] if by else [])).write.mode("errorifexists").parquet(path, partitionBy=by)
        counted = _observed(seen)
        self.violations += [(name, rule, counted[rule]) for rule in metrics if counted.get(rule)]
        found = {None: path}
        if by is not None:
            found = {unquote(n.partition("=")[2]): f"{path}/{n}" for n in claims.names(self.spark, path) if n.startswith(f"{by}=")}
        for part, at in found.items():
            self._line(name, part, at, counted.get("rows", 0), schema)

    def table(self, name: str, rows: DataFrame, schema: int = SCHEMA_VERSION) -> None:
        self.whole.add(name)
        self.rows(name, rows, schema)

    def only(self, name: str, parts: DataFrame, rows: DataFrame) -> None:
        """Write some parts of a table anew; `parts` has them in one column."""
        by = PARTITIONS[name]
        self.parts[name] = {r.part for r in parts.select(F.col(by).cast("string").alias("part")).distinct().collect()}
        self.rows(name, rows)

    def dead(self, name: str, keys: DataFrame) -> None:
        """Take the rows with these keys away from all folders written before."""
        seen, path = Observation(), self._folder(name)
        keys.distinct().observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance").write.mode("errorifexists").parquet(path)
        self._line(name, None, path, _observed(seen).get("rows", 0), SCHEMA_VERSION, ",".join(keys.columns))

    @cached_property
    def before(self) -> Version | None:
        """The version before, None if this one needs nothing of it."""
        if self.whole >= set(Model.table_names()) and not self.parts:
            return None
        return read_version(self.spark, self.root, latest_version(self.spark, self.root, before=self.version))

    @cached_property
    def stored(self) -> list[Row]:
        return [] if self.before is None else read_lines(self.spark, self.before)

    def manifest(self) -> list[Row]:
        """The lines written, and those of the version before that hold on."""
        def holds(line: Row) -> bool:
            replaced = line["keys"] is None and line["part"] in self.parts.get(line["table"], ())
            return line["table"] not in self.whole and not replaced

        return [*self.lines, *[Row(**{**line.asDict(), "version": self.version}) for line in self.stored if holds(line)]]

    def give_up(self) -> None:
        for path in self.folders:
            remove(self.spark, path)

    def refuse_violations(self, allow: Rules) -> None:
        broken = [x for x in self.violations if x[:2] not in allow]
        if broken:
            raise ConstraintError(sorted(broken))

    def commit(self, **about: int | str | None) -> None:
        """Write the manifest, then claim the version."""
        path = f"{self.root}/manifest/{uuid.uuid4().hex}"
        self.folders.append(path)
        self.spark.createDataFrame(self.manifest(), _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(path)
        if not claims.put(self.spark, f"{self.root}/versions/{self.version}.json", {"version": self.version, "manifest": path, **about}):
            raise FileExistsError(f"version {self.version} under {self.root} is published")


def _about(model: Model, feed: Mapping[str, int | str | None] | None) -> dict[str, int | str | None]:
    own = {} if model.standing is None else {"buckets": model.standing.buckets, "recent_n": model.standing.recent_n}
    return {**own, **(feed or {})}


def _feed_before(spark: SparkSession, root: str, version: int) -> dict[str, int | str | None]:
    """How far a feed was folded in, as the version before says; nothing without one."""
    try:
        last = read_version(spark, root, latest_version(spark, root, before=version))
    except FileNotFoundError:
        return {}
    return {"feed_batch": last.feed_batch, "feed_open": last.feed_open}


def publish(
    model: Model, root: str, version: int, changed: list[str] | None = None, schema: int = SCHEMA_VERSION, check: bool = True,
    allow: Rules = quality.OF_MARKERS,
) -> None:
    """Write version `version` of the model under `root`; a version that exists is refused, and so is one that breaks a rule that is not
    in `allow`.

    With `changed`, only those tables are written and the version shares the stored files of the others with the latest version
    before; a standing is then written as well, if the model has one. `schema`: of the rows, for tables kept by an older one.
    """
    spark = model.members.sparkSession
    _refuse_existing(spark, root, version)
    feed = {}
    if changed is not None:
        latest_version(spark, root, before=version)
        feed = _feed_before(spark, root, version)
    tables = stored_tables(model)
    names = list(tables) if changed is None else [*changed, *[n for n in tables if n.startswith("standing_")]]
    work = _Publication(spark, root, version)
    if model.standing is None:
        # a standing stored before doesn't hold for these tables
        work.whole |= {f"standing_{name}" for name in standing_schemas()}
    try:
        for name in names:
            work.table(name, tables[name], schema)
        if check and schema == SCHEMA_VERSION:
            work.refuse_violations(allow)
            _check(work, _model_of(spark, root, work.manifest(), _member_id(model), {}), set(names), {})
            work.refuse_violations(allow)
        work.commit(**_about(model, feed))
    except Exception:
        work.give_up()
        raise


def publish_outcome(
    outcome: Outcome, root: str, version: int, changed: list[str], feed: Mapping[str, int | str | None] | None = None,
    check: bool = True, allow: Rules = quality.OF_MARKERS,
) -> None:
    """Write a batch outcome as one version: its `changed` tables, then members and roster.

    Of a table for which the outcome names what it touches, only that is written; of one for which it names what is gone, only the
    keys of these rows. The second step reads the tables of the first one back, so the merge of a large fact is computed once; where the
    model keeps a standing, it writes just the members that changed. All become visible together. What is stored on the way is removed.
    """
    spark, model = outcome.changed.members.sparkSession, outcome.changed
    _refuse_existing(spark, root, version)
    tables, work = stored_tables(model), _Publication(spark, root, version)
    own = [n for n in tables if n.startswith("standing_")]
    stored = read_version(spark, root, latest_version(spark, root, before=version))
    # a standing that the version before doesn't have, or has otherwise, is written whole
    new = model.standing is not None and (stored.buckets, stored.recent_n) != (model.standing.buckets, model.standing.recent_n)
    names = [*changed, *[n for n in own if new or n in outcome.touched or n in outcome.removed]]
    if model.standing is None:
        work.whole |= {f"standing_{name}" for name in standing_schemas()}
    try:
        with scope(spark):
            for name in names:
                if new and name in own:
                    work.table(name, tables[name])
                elif name in outcome.removed:
                    work.dead(name, outcome.removed[name])
                elif name in outcome.touched:
                    keys = outcome.touched[name].distinct()
                    rows = outcome.rows.get(name)
                    work.only(name, keys, tables[name].join(keys, PARTITIONS[name], "left_semi").select(*tables[name].columns) if rows is None else rows)
                else:
                    work.table(name, tables[name])
            kind, about = _member_id(model), _about(model, None)
            back = _model_of(spark, root, work.manifest(), kind, about)
            if outcome.settle_rows is not None:
                _, other = outcome.settle_rows(back)
                for name, rows in other.items():
                    if not rows.isEmpty():
                        if name == "members":
                            work.dead(name, rows.select("member_id"))
                        work.rows(name, rows)
            else:
                settled = outcome.settle(back)
                after = [n for n in ["members", "stage2_roster"] if getattr(settled, n) is not getattr(back, n) and n not in changed]
                for name in after:
                    work.table(name, getattr(settled, name))
            if check:
                work.refuse_violations(allow)
                _check(work, _model_of(spark, root, work.manifest(), kind, about), set(work.whole), outcome.removed)
                work.refuse_violations(allow)
        work.commit(**_about(model, feed if feed is not None else _feed_before(spark, root, version)))
    except Exception:
        work.give_up()
        raise


def compact(spark: SparkSession, root: str, version: int, member_id: T.DataType = T.StringType()) -> list[str]:
    """Publish version `version` with every table that has dead keys or an older schema written whole again; gives their names."""
    last = latest_version(spark, root, before=version)
    about, work = read_version(spark, root, last), _Publication(spark, root, version)
    lines = read_lines(spark, about)
    names = sorted({line["table"] for line in lines if line["keys"] is not None or line["schema"] < SCHEMA_VERSION})
    model = _model_of(spark, root, lines, member_id, {"buckets": about.buckets, "recent_n": about.recent_n})
    try:
        for name in names:
            work.table(name, stored_tables(model)[name])
        feed = {"feed_batch": about.feed_batch, "feed_open": about.feed_open}
        work.commit(**_about(model, feed))
    except Exception:
        work.give_up()
        raise
    return names


def _member_id(model: Model) -> T.DataType:
    return model.members.schema["member_id"].dataType


# --- the gate -----------------------------------------------------------------------------


def _check(work: _Publication, after: Model, whole: set[str], removed: Mapping[str, DataFrame]) -> None:
    """Keys and references of what a version writes.

    Of tables written whole every row, of others the rows written: stored ones were checked when they came. Where a table that others
    refer to is written whole or loses rows, those that refer to it are asked for the keys it lost.
    """
    spark, kind = work.spark, _member_id(after)
    fresh, written = [line for line in work.lines if line["keys"] is None], {}
    for name in {line["table"] for line in fresh} & set(Model.table_names()):
        written[name] = _read(spark, [line for line in fresh if line["table"] == name], work.root, name, schemas(kind)[name])
    work.violations += quality.violations_of(after, written, whole)
    shrunk = [r for r in quality.REFERENCES if (r[2] in whole or r[2] in removed) and not (r[0] in whole and r[0] in written)]
    if not shrunk:
        return
    before = _model_of(spark, work.root, work.stored, kind, {})
    with scope(spark):
        gone: dict[tuple[str, str], tuple[DataFrame, int]] = {}
        for table, column, other, key in shrunk:
            if (other, key) not in gone:
                # once for all tables that refer to it
                old, new = (getattr(m, other).select(key) for m in (before, after))
                lost = cut_lineage(old.join(new, key, "left_anti"))
                gone[other, key] = lost, lost.count()
            lost, rows = gone[other, key]
            keys = lost.select(F.col(key).alias(column))
            n = getattr(after, table).join(spread(keys, rows), column, "left_semi").count() if rows else 0
            work.violations += [(table, f"{column} in {other}", n)] if n else []


# --- reading ------------------------------------------------------------------------------


def _read(spark: SparkSession, lines: list[Row], root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table from its folders."""
    dead = [line for line in lines if line["keys"] is not None]
    sizes = {line["path"]: line["rows"] for line in dead}
    groups: dict[tuple, list[str]] = {}
    for line in lines:
        if line["keys"] is None:
            later = tuple(sorted((d["keys"], d["path"]) for d in dead if d["written"] > line["written"]))
            groups.setdefault((line["schema"], later), []).append(line["path"])
    tables = []
    for (version, later), paths in sorted(groups.items()):
        stored = columns_of(name, version, schema)
        rows = spark.read.schema(stored).option("basePath", _base(root, name)).parquet(*sorted(paths))
        rows = upgrade(rows, name, version)
        for keys in sorted({k for k, _ in later}):
            columns = keys.split(",")
            kinds = T.StructType([schema[c] for c in columns])
            folders = [path for k, path in later if k == keys]
            gone = spread(spark.read.schema(kinds).parquet(*folders), sum(sizes[path] for path in folders))
            rows = rows.join(gone, columns, "left_anti")
        tables.append(rows.select(*schema.names))
    if not tables:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, tables)


def _model_of(spark: SparkSession, root: str, lines: list[Row], member_id: T.DataType, about: Mapping[str, int | str | None]) -> Model:
    """The model whose folders a manifest names."""
    own: dict[str, list[Row]] = {name: [] for name in table_schemas(member_id)}
    for line in lines:
        own[line["table"]].append(line)
    tables = {name: _read(spark, own[name], root, name, schema) for name, schema in schemas(member_id).items()}
    standing = None
    if about.get("buckets"):
        stored = {name: _read(spark, own[f"standing_{name}"], root, f"standing_{name}", schema) for name, schema in standing_schemas(member_id).items()}
        standing = Standing(**stored, buckets=about["buckets"], recent_n=about["recent_n"])
    return Model(**tables, standing=standing)


def load(
    spark: SparkSession, root: str, version: int | None = None, member_id: T.DataType = T.StringType()
) -> Model:
    """The model of one version, the latest by default, with its standing if it has one."""
    chosen = read_version(spark, root, latest_version(spark, root) if version is None else version)
    return _model_of(spark, root, read_lines(spark, chosen), member_id, {"buckets": chosen.buckets, "recent_n": chosen.recent_n})


def export_json(df: DataFrame, path: str) -> None:
    """Rows of a result as JSON lines."""
    df.write.mode("errorifexists").json(path)
