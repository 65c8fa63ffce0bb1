"""Personal data: fixed formats, and identifiers that bootstrapped contexts give away.

The fixed formats (email, ip, card, phone) are found in every text and are the seeds. Around every mention of a seed,
and of any other word that looks like an identifier, lexical patterns are read: the word before, the two words before,
and the words on either side. Words that reach further than a window of 64 characters before and 32 after are in no pattern. Patterns and instances form a graph, which Spark scores in rounds:

* a pattern's score for a kind is the belief in its instances of that kind, over the number of its distinct instances
  plus one; patterns with little support or a low score take no part;
* the belief in an instance that is no seed is the noisy-or of its patterns' scores.

Mentions of instances believed in after the last round are added as spans. Spans of the fixed formats always stay.

Null texts count as empty and give no spans. Repeated rows and null ids stay rows of their own; an empty table gives
an empty result. Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import free_name
from rollcall.sources.lineage import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: A pattern takes part from so much support and such a score; an instance from such a belief.
SUPPORT, PRECISION, BELIEF, ROUNDS = 8.0, 0.7, 0.75, 3

# The parts of the fixed formats, written so that a search never looks at a run of characters twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@]")
_MENTION = re.compile(r"(?<![\w@+.%/-])(?:[^\W\d]|[+.%/-])*+[\d@][\w@+.%/-]*")
#: Context looked at on either side, in characters.
_BEFORE, _AFTER = 64, 32


def small(part: str) -> bool:
    """At most 255; the number may be too long to be read as one."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every address has one @, so each is found from its @: the domain to the right, the name to the left."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text or not _CLUE.search(text):
        return found
    if "@" in text:
        found["email"] = emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(small(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def _other(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Words that look like identifiers (three digits or an @) and touch no fixed format."""
    at = 0
    for m in _MENTION.finditer(text):
        word = m.group()
        if "@" not in word and sum(c.isdigit() for c in word) < 3:
            continue
        start, end = m.span()
        while end > start and text[end - 1] in ".-/%+":
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end - start >= 5 and not (at < len(taken) and taken[at][0] < end):
            yield start, end


def words_of(text: str, start: int, end: int) -> list[str]:
    """The words between two places, in lower case with all digits alike."""
    return re.sub(r"\d", "0", text[start:end].lower()).split()


def contexts(text: str, start: int, end: int) -> list[str]:
    low, high = max(0, start - _BEFORE), min(len(text), end + _AFTER)
    before, after = words_of(text, low, start), words_of(text, end, high)
    # a word that reaches over the edge of the window is no context: what is left of it is another word
    if before and low and not text[low - 1].isspace() and not text[low].isspace():
        before = before[1:]
    if after and high < len(text) and not text[high].isspace() and not text[high - 1].isspace():
        after = after[:-1]
    before, after = before[-2:], after[:1]
    found = []
    if before:
        found.append("1 " + before[-1])
        if len(before) == 2:
            found.append("2 " + " ".join(before))
        if after:
            found.append(f"3 {before[-1]} _ {after[0]}")
    return found


def instance(text: str) -> str:
    return text.lower() if len(text) <= 128 else hashlib.sha256(text.encode()).hexdigest()


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct(
    [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]
)
_ROW = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:int,start:int,end:int>>, "
    "seen array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"
)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fixed formats of each text, and its mentions with their contexts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            ids, hashes, texts = batch.slice(at, 2000).columns
            spans, seen = [], []
            for text in texts.to_pylist():
                text = text or ""
                found = base_spans(text)
                mine = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in found[kind]]
                spans.append(mine)
                rows = [*mine]
                if _CLUE.search(text):
                    rows += [(None, a, b) for a, b in _other(text, sorted((a, b) for _, a, b in mine))]
                seen.append([(k, a, b, instance(text[a:b]), contexts(text, a, b)) for k, a, b in rows])
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, hashes, *counts,
                    pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in spans], pa.string()),
                    pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(_SPAN)),
                    pa.array([[dict(zip(("kind", "start", "end", "instance", "patterns"), s, strict=True)) for s in x] for x in seen], pa.list_(_SEEN)),
                ],
                _NAMES,
            )


_NAMES = ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"]


def keyed(docs: DataFrame) -> DataFrame:
    """Id, hash of the text, text. Rows that agree in the first two have the same spans."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def believed(seen: DataFrame, support: float, precision: float, belief: float, rounds: int) -> DataFrame:
    """`instance, kind` of the instances that are no seeds and that the patterns speak for."""
    pairs = cut_lineage(
        seen.select("instance", "kind", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance").agg(F.max("kind").alias("seed"))
    )
    number = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    beliefs = None
    for _ in range(rounds):
        votes = pairs.where("seed is not null").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
        if beliefs is not None:
            votes = votes.unionByName(
                pairs.where("seed is null").join(beliefs, "instance").select("pattern", "kind", "belief")
            )
        hits = votes.groupBy("pattern", "kind").agg(F.sum("belief").alias("hits")).where(F.col("hits") >= support)
        good = hits.join(number, "pattern").withColumn("score", F.col("hits") / (F.col("instances") + 1)).where(
            F.col("score") >= precision
        )
        spoken = pairs.where("seed is null").join(good.select("pattern", "kind", "score"), "pattern")
        either = spoken.groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("belief")
        )
        best = either.groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("last"))).alias("best"))
        beliefs = cut_lineage(
            best.select("instance", (-F.col("best.last")).alias("kind"), F.col("best.belief").alias("belief")).where(F.col("belief") >= belief)
        )
    return beliefs.select("instance", "kind")


def found_more(rows: DataFrame, **levels: float) -> DataFrame:
    """Spans beside the fixed formats: `doc_id, text_hash, more`, for texts that have any."""
    seen = rows.select("doc_id", "text_hash", F.explode("seen").alias("s")).select("doc_id", "text_hash", "s.*")
    trust = believed(seen, **levels)
    spans = seen.where("kind is null").drop("kind").join(trust, "instance")
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def find(
    docs: DataFrame, support: float = SUPPORT, precision: float = PRECISION, belief: float = BELIEF, rounds: int = ROUNDS
) -> DataFrame:
    """For every row of `docs`: `doc_id, text_hash`, counts and digest of the fixed formats, and `found`, all spans as
    structs of kind (index in KINDS), start and end, by kind and start."""
    rows = cut_lineage(keyed(docs).mapInArrow(_read, _ROW))
    more = found_more(rows, support=support, precision=precision, belief=belief, rounds=rounds)
    more = more.withColumnsRenamed({"doc_id": "_pii_doc", "text_hash": "_pii_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.col("text_hash") == F.col("_pii_hash"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return rows.join(more, same, "left").select(*_NAMES[:-2], spans.alias("found"))


def kind_name(kind: Column, form: str = "{}") -> Column:
    return F.element_at(F.array(*[F.lit(form.format(k)) for k in KINDS]), kind + 1)


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, **levels: float) -> DataFrame:
    """`docs` with every span found replaced by its kind in brackets; all other columns as they are."""
    doc, text_hash, spans = (free_name(docs, name) for name in ("_pii_doc", "_pii_hash", "_pii_found"))
    found = find(docs, **levels).where(F.size("found") > 0).select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("found").alias(spans)
    ).dropDuplicates([doc, text_hash])
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text_hash))
    joined = docs.join(found, same, "left")
    # text before each span, then its kind; a span that begins inside the one before it adds nothing
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(done, s):
        new = F.concat(done["text"], F.substr(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.upper(kind_name(s["kind"], "[{}]")))
        inside = s["start"] < done["at"]
        return F.struct(
            F.when(inside, done["text"]).otherwise(new).alias("text"), F.greatest(done["at"], s["end"]).alias("at")
        )

    clean = F.aggregate(ordered, start, step, lambda done: F.concat(done["text"], F.substr(F.col("text"), done["at"] + 1)))
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
