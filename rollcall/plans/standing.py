"""The standing of members: what the rules need of each one, kept up to date by signed changes.

A batch reads and writes the standing of the members it touches instead of reading all facts again:

* `coverage`: how many present marks a member has at sessions of each topic. A mark or a session's topic that changes takes one away
  from the old topic and adds one to the new; a row that reaches nothing goes.
* `tallies`: in how many outings and services a member took part. A replaced or deleted event takes its members' away.
* `recent`: the statuses at the newest sessions a member has a mark for. The newest of two such lists merge to the newest of both,
  and a mark that is overwritten takes the place of the old one.

Rows carry the `bucket` of their member, by which the tables are stored, so that the buckets of a few members are all that is read.
Levels only rise and topics are never taken away, so once every level is settled, only members a batch touches can become complete.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.values import ABSENT, PRESENT
from rollcall.model import MEMBER_COLUMNS, Model, Rules, Standing
from rollcall.plans import progress
from rollcall.plans.refresh import moment, promote, wanted_roster
from rollcall.sources.lineage import cut_lineage, spread

BUCKETS = 16
KEY = ["bucket", "member_id"]
_TALLIES = ["n_outings", "n_services"]


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("member_id").cast("string")), F.lit(buckets)).cast("int").alias("bucket")


# --- from all facts -----------------------------------------------------------------------


def _present_topics(marks: DataFrame, sessions: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    topics = sessions.where(F.col("topic_id").isNotNull()).select("session_id", "topic_id")
    rows = marks.where(F.col("status") == PRESENT).select("session_id", "member_id").join(topics, "session_id")
    return rows.select(bucket_of(buckets), "member_id", "topic_id", F.lit(sign).cast("bigint").alias("n_present"))


def _taken_part(bridge: DataFrame, column: str, buckets: int, sign: int = 1) -> DataFrame:
    counts = [F.lit(sign if c == column else 0).cast("bigint").alias(c) for c in _TALLIES]
    return bridge.select(bucket_of(buckets), "member_id", *counts)


def _summed(rows: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Rows with the same keys added up; those that come to nothing are left out."""
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    return sums.where(" or ".join(f"{c} <> 0" for c in counts))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """bucket, member_id, recent: the `n` newest of `rows` (session_date, status), one row a date, newest first."""
    ranked = rows.withColumn("rank_", F.row_number().over(progress.newest_first(KEY))).where(F.col("rank_") <= n)
    listed = F.sort_array(F.collect_list(F.struct("session_date", "status")), asc=False)
    return ranked.groupBy(*KEY).agg(listed.alias("recent"))


def read_standing(model: Model, rules: Rules = Rules(), buckets: int = BUCKETS) -> Standing:
    """The standing of all members, from all facts."""
    bridges = _taken_part(model.outing_members, "n_outings", buckets).unionByName(_taken_part(model.service_members, "n_services", buckets))
    dated = model.marks.select("session_id", "member_id", "status").join(model.sessions.select("session_id", "session_date"), "session_id")
    return Standing(
        coverage=_summed(_present_topics(model.marks, model.sessions, buckets), [*KEY, "topic_id"], ["n_present"]),
        tallies=_summed(bridges, KEY, _TALLIES),
        recent=_newest(dated.select(bucket_of(buckets), "member_id", "session_date", "status"), rules.recent_n),
        buckets=buckets, recent_n=rules.recent_n,
    )


def with_standing(model: Model, as_of: str, rules: Rules = Rules(), buckets: int = BUCKETS) -> Model:
    """The model with every level settled and its standing."""
    settled = promote(model, as_of, rules)
    return settled.with_tables(standing=read_standing(settled, rules, buckets))


# --- changes ------------------------------------------------------------------------------


def _touched(change: DataFrame) -> DataFrame:
    return change.select(*KEY).distinct()


def _with_change(stored: DataFrame, change: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """`stored` with signed counts added, those of `change`, a stored table; rows of other members pass by."""
    touched = spread(_touched(change), change.count())
    own = stored.join(touched, KEY, "left_semi").unionByName(change)
    return stored.join(touched, KEY, "left_anti").unionByName(_summed(own, keys, counts).select(*stored.columns))


def marks_changed(
    standing: Standing, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], new: DataFrame
) -> tuple[Standing, DataFrame, dict[str, DataFrame]]:
    """The standing after marks and sessions changed; the members with another coverage; by table, the buckets that differ.

    `before` and `after`: (marks, sessions), as far as they may differ. `new`: member_id, session_date, status of the marks written.
    """
    both = _present_topics(*after, standing.buckets).unionByName(_present_topics(*before, standing.buckets, -1))
    change = cut_lineage(_summed(both, [*KEY, "topic_id"], ["n_present"]))
    coverage = _with_change(standing.coverage, change, [*KEY, "topic_id"], ["n_present"])
    new = cut_lineage(new.select(bucket_of(standing.buckets), "member_id", "session_date", "status"))
    touched = _touched(new)
    old = standing.recent.join(touched, KEY, "left_semi").select(*KEY, F.inline("recent"))
    dates = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    dates = dates.groupBy(*KEY, "session_date").agg(F.max_by("status", "new_").alias("status"))
    newest = _newest(dates, standing.recent_n)
    recent = standing.recent.join(touched, KEY, "left_anti").unionByName(newest.select(*standing.recent.columns))
    buckets = {"coverage": change.select("bucket").distinct(), "recent": new.select("bucket").distinct()}
    return replace(standing, coverage=coverage, recent=recent), _touched(change).select("member_id"), buckets


def bridge_changed(
    standing: Standing, column: str, removed: DataFrame, added: DataFrame
) -> tuple[Standing, DataFrame, dict[str, DataFrame]]:
    """The standing after rows of a bridge went and came; the members with another tally; the buckets that differ."""
    both = _taken_part(added, column, standing.buckets).unionByName(_taken_part(removed, column, standing.buckets, -1))
    change = cut_lineage(_summed(both, KEY, _TALLIES))
    tallies = _with_change(standing.tallies, change, KEY, _TALLIES)
    return replace(standing, tallies=tallies), change.select("member_id"), {"tallies": change.select("bucket").distinct()}


def members_removed(standing: Standing, ids: DataFrame) -> Standing:
    """The standing without some members."""
    keys = ids.select(bucket_of(standing.buckets), "member_id").distinct()
    return replace(standing, **{name: table.join(keys, KEY, "left_anti") for name, table in standing.tables().items()})


# --- the rules for touched members --------------------------------------------------------


def topic_coverage(model: Model) -> DataFrame:
    """member_id, n_topics for members present in at least one topic; as from all marks."""
    return _n_topics(model, model.standing.coverage).where(F.col("n_topics") > 0)


def _n_topics(model: Model, coverage: DataFrame) -> DataFrame:
    words = progress.n_words(model)
    bits = progress.with_bits(model, coverage).groupBy("member_id").agg(progress.bitmap(words).alias("bits_"))
    return bits.select("member_id", progress.n_bits(F.col("bits_"), words).alias("n_topics"))


def standings(model: Model, keys: DataFrame | None, rules: Rules = Rules()) -> DataFrame:
    """Member columns, n_topics, n_outings, n_services, total_topics, and lapsed (null without a mark): of the members among `keys`
    (bucket, member_id), or of all."""

    def own(table: DataFrame) -> DataFrame:
        return table if keys is None else table.join(keys, KEY, "left_semi")

    standing = model.standing
    last = F.slice("recent", 1, rules.recent_n)
    lapsed = (F.size(last) == rules.recent_n) & F.forall(last, lambda x: x["status"] == ABSENT)
    rows = model.members if keys is None else model.members.join(keys.select("member_id"), "member_id", "left_semi")
    rows = (
        rows.join(_n_topics(model, own(standing.coverage)), "member_id", "left")
        .join(own(standing.tallies).select("member_id", *_TALLIES), "member_id", "left")
        .join(own(standing.recent).select("member_id", lapsed.alias("lapsed")), "member_id", "left")
    )
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ["n_topics", *_TALLIES]}
    return rows.withColumns({**counts, "total_topics": progress.topic_total(model)})


def promotion_eligible(model: Model) -> DataFrame:
    """member_id of everyone who meets the whole promotion rule; as from all facts."""
    return standings(model, None).where(progress.is_complete()).select("member_id")


def moved_members(model: Model, touched: DataFrame, marked: DataFrame | None, as_of: str, rules: Rules = Rules()) -> DataFrame:
    """The members whose activity or level changes, as they are then. Activity is looked at for the `marked`, the level for the touched."""
    buckets = model.standing.buckets
    keys = touched.select("member_id").withColumn("marked_", F.lit(False))
    if marked is not None:
        keys = keys.unionByName(marked.select("member_id").withColumn("marked_", F.lit(True)))
    keys = cut_lineage(keys.groupBy("member_id").agg(F.bool_or("marked_").alias("marked_")).select(bucket_of(buckets), "member_id", "marked_"))
    keys = spread(keys)
    rows = standings(model, keys, rules).join(keys.select("member_id", "marked_"), "member_id")
    newly = progress.is_complete() & (F.col("level") < 2)
    active = F.when(F.col("marked_") & (F.col("level") == 1) & F.col("lapsed").isNotNull(), ~F.col("lapsed")).otherwise(F.col("active"))
    after = rows.withColumns({"newly_": newly, "new_active_": active}).where(F.col("newly_") | (F.col("new_active_") != F.col("active")))
    after = after.withColumns({
        "active": F.col("new_active_"),
        "level": F.when(F.col("newly_"), F.lit(2)).otherwise(F.col("level")),
        "promoted_at": F.when(F.col("newly_"), F.coalesce("promoted_at", moment(as_of))).otherwise(F.col("promoted_at")),
    })
    return after.select(*MEMBER_COLUMNS)


def settle_touched(model: Model, touched: DataFrame, marked: DataFrame | None, as_of: str, rules: Rules = Rules()) -> tuple[Model, dict[str, DataFrame]]:
    """The model with activity, levels and roster brought up to date, and the rows of members and roster that are new."""
    moved = cut_lineage(moved_members(model, touched, marked, as_of, rules))
    added = wanted_roster(moved, as_of).join(model.stage2_roster.select("member_id"), "member_id", "left_anti")
    added = cut_lineage(added.select(*model.stage2_roster.columns))
    members = model.members.join(spread(moved).select("member_id"), "member_id", "left_anti").unionByName(moved)
    after = model.with_tables(members=members, stage2_roster=model.stage2_roster.unionByName(added))
    return after, {"members": moved, "stage2_roster": added}
