"""The constraints of the schema as checks, since Spark tables do not enforce them."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.values import ABSENT, PRESENT
from rollcall.model import KEYS, Model, schemas
from rollcall.sources.lineage import cut_lineage, spread

#: (table, column, referenced table, referenced column); a null reference is allowed.
REFERENCES = [
    ("sessions", "topic_id", "topics", "topic_id"),
    ("marks", "session_id", "sessions", "session_id"),
    ("marks", "member_id", "members", "member_id"),
    ("outing_members", "outing_id", "outings", "outing_id"),
    ("outing_members", "member_id", "members", "member_id"),
    ("service_members", "service_id", "services", "service_id"),
    ("service_members", "member_id", "members", "member_id"),
    ("stage2_roster", "member_id", "members", "member_id"),
    ("stage2_marks", "session_id", "stage2_sessions", "session_id"),
    ("stage2_marks", "member_id", "members", "member_id"),
    ("marks", "marked_by", "markers", "marker_id"),
    ("stage2_marks", "marked_by", "markers", "marker_id"),
    ("sessions", "created_by", "markers", "marker_id"),
    ("outings", "created_by", "markers", "marker_id"),
    ("services", "created_by", "markers", "marker_id"),
    ("stage2_sessions", "created_by", "markers", "marker_id"),
]

#: Markers are accounts of another system, so a name that is no marker here need not be wrong.
OF_MARKERS = frozenset((table, f"{column} in markers") for table, column, other, _ in REFERENCES if other == "markers")

#: (table, column): unique among the rows that have a value.
UNIQUE_IF_GIVEN = [("members", "phone")]


@dataclass(frozen=True)
class Rule:
    """A rule of a table. `key`: what a row is counted by, or null for rows that hold to it. `other`: the rule that has the keys
    a reference must be among."""

    table: str
    name: str
    key: Column
    kind: str
    other: str | None = None


def _text(columns: list[str]) -> Column:
    """A key as text, different for different keys: the parts of a key of several columns come with their lengths."""
    texts = [F.col(c).cast("string") for c in columns]
    if len(columns) == 1:
        return texts[0]
    return F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def row_metrics(table: str) -> dict[str, Column]:
    """Aggregates of the rules that a row breaks by itself: how many rows do."""
    required = [f.name for f in schemas()[table].fields if not f.nullable]
    rules = {"required columns": F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]))}
    if table in ("marks", "stage2_marks"):
        rules["status"] = F.count_if(~F.col("status").isin(PRESENT, ABSENT))
    return rules


def _rules(table: str) -> list[Rule]:
    """The rules that need more than one row."""
    rules = [Rule(table, f"unique {', '.join(key)}", _text(key), "unique") for key in KEYS[table]]
    rules += [Rule(table, f"unique {c}", _text([c]), "unique if given") for t, c in UNIQUE_IF_GIVEN if t == table]
    return rules + [Rule(t, f"{c} in {o}", _text([c]), "reference", f"{o}: unique {k}") for t, c, o, k in REFERENCES if t == table]


def _each(rows: DataFrame, rules: list[Rule], n: int = 1) -> DataFrame:
    """rule, key, n: the keys of each row, in one scan of the table."""
    name = lambda r: F.lit(f"{r.table}: {r.name}")
    each = F.array(*[F.struct(name(r).alias("rule"), r.key.alias("key")) for r in rules])
    return rows.select(F.inline(each)).withColumn("n", F.lit(n).cast("bigint"))


def _keys(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, key, n: how often each key of each rule occurs. Combined inside the map tasks first."""
    return _each(rows, rules).groupBy("rule", "key").agg(F.sum("n").alias("n"))


def _telling(keys: DataFrame, rules: list[Rule]) -> DataFrame:
    """The keys that can tell of a broken rule: those found again, those of references, and those that a reference has to be among."""
    references = [r for r in rules if r.kind == "reference"]
    names = {f"{r.table}: {r.name}" for r in references} | {r.other for r in references}
    return keys.where((F.col("n") > 1) | F.col("rule").isin(sorted(names)))


def _broken(keys: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, violations, of the rules that are broken by `keys`, a stored table. A unique key counts the rows beyond the first of each key."""
    of = lambda *kinds: [f"{r.table}: {r.name}" for r in rules if r.kind in kinds]
    again = keys.where(F.col("rule").isin(of("unique")) | F.col("rule").isin(of("unique if given")) & F.col("key").isNotNull())
    again = again.where("n > 1").select("rule", (F.col("n") - 1).alias("n"))
    targets = [F.lit(x) for r in rules if r.kind == "reference" for x in (f"{r.table}: {r.name}", r.other)]
    if targets:
        known = spread(keys.select(F.col("rule").alias("other"), "key"), keys.count())
        asked = keys.where(F.col("rule").isin(of("reference")) & F.col("key").isNotNull())
        asked = asked.withColumn("other", F.create_map(*targets)[F.col("rule")])
        again = again.unionByName(asked.join(known, ["other", "key"], "left_anti").select("rule", "n"))
    return again.groupBy("rule").agg(F.sum("n").alias("violations"))


def constraint_check(model: Model) -> DataFrame:
    """table_name, rule, violations: one row per rule, 0 when it holds.

    Each table is scanned for its keys once, and once for the rules of single rows; the keys of all tables then meet in one aggregate.
    """
    spark, tables = model.members.sparkSession, model.tables()
    rules = [r for name in tables for r in _rules(name)]
    keys = cut_lineage(_telling(reduce(DataFrame.unionByName, [_keys(tables[name], _rules(name)) for name in tables]), rules))
    every = spark.createDataFrame([(f"{r.table}: {r.name}", r.table, r.name) for r in rules], "id string, table_name string, rule string")
    broken = _broken(keys, rules).withColumnRenamed("rule", "id")
    many = every.join(broken, "id", "left").select("table_name", "rule", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))
    single = []
    for name, rows in tables.items():
        metrics = row_metrics(name)
        found = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"m{i}").alias("violations")) for i, rule in enumerate(metrics)])
        single.append(rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(metrics.values())]).select(F.lit(name).alias("table_name"), F.inline(found)))
    return reduce(DataFrame.unionByName, single, many)


def violations_of(model: Model, written: dict[str, DataFrame], whole: set[str]) -> list[tuple[str, str, int]]:
    """(table, rule, rows) of the rules over several rows that the rows written break, in a model that has them.

    Keys of tables that are referred to come from the whole model, all others from the rows written. `whole`: tables of which every row
    is among those written.
    """
    rules = [r for name in written for r in _rules(name)]
    # all tables meet in one aggregate, so that a key moves once
    keys = [_each(rows, _rules(name)) for name, rows in written.items()]
    for target in {r.other for r in rules if r.kind == "reference"}:
        table = target.partition(":")[0]
        if table not in whole:
            own = [r for r in _rules(table) if f"{r.table}: {r.name}" == target]
            # there, but not to be counted
            keys.append(_each(getattr(model, table), own, 0))
    if not keys:
        return []
    found = cut_lineage(_telling(reduce(DataFrame.unionByName, keys).groupBy("rule", "key").agg(F.sum("n").alias("n")), rules))
    return sorted((*r.rule.split(": ", 1), r.violations) for r in _broken(found, rules).collect())
