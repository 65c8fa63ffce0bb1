"""URL filters: fixed host and path rules, and association rules mined from labelled addresses.

Every part of an address gives a token, whatever its place: scheme, whole host, each host label, each path segment (digits folded),
number of segments, extension, each query key, each key with its value (digits folded), fragment. Tokens of fewer than `LEAST` labelled
addresses can't be in a rule and go first. Tokens that the same labelled addresses have are one item, so a fixed part of many
addresses does not multiply the sets. Spark's FP-growth mines the sets of all frequent items of the labelled addresses, however many an
address has: once to count the sets tried, once among the blocked addresses for what a rule can be made of, and once more for how many
addresses have these. Sets are listed one after the other inside the tasks and those without a rule are not kept, so memory does not
follow their number; the time does, and addresses that share m items but no two of them the same addresses have up to 2^m.

Rules "tokens -> block" stay if enough addresses hold them, their confidence is high, and chance does not explain it: with the
share p of blocked addresses, the probability of k or more blocked among n is at most exp(-n * KL(k/n, p)) (Chernoff's bound,
exact at confidence 1), and has to stay under `CHANCE` divided by the number of sets tried (Bonferroni). So labels that have nothing
to do with the addresses give no rule at any number of them, but for a chance of one in a hundred.

Matching goes through an inverted index: each rule is filed under the rarest of its tokens, addresses meet the rules filed under
their tokens, and a rule matches if the address has all its tokens. That is done once for each distinct set of tokens.

Null addresses have empty host and path, no tokens, and are allowed. Repeated rows and null ids stay rows of their own; an empty table
gives an empty result, and without labels there are no mined rules. Other columns don't matter.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.sources.lineage import cut_lineage

#: Fixed rules of the contract: verdict, host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Blocked addresses that a rule needs whatever their share is, and the probability that one chance rule passes.
LEAST, CHANCE = 5, 0.01


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows the path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    found = F.instr(text, "://")
    rest = F.when(found > 0, F.substr(text, found + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path, F.substr(after, F.length(path) + 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of an address."""
    host, path, tail = parts(url)
    fold = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(tail, r"^\?([^#]*)", 1), "&"), lambda x: x != "")
    one = {
        "scheme": F.lower(F.regexp_extract(url, "^([^:/?#]*)://", 1)),
        "host": host,
        "depth": F.when(F.size(steps) > 0, F.size(steps).cast("string")),
        "ends": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
        "fragment": F.regexp_extract(tail, "#(.+)", 1),
    }
    many = {
        "label": F.split(host, r"\."), "step": F.transform(steps, fold), "key": F.transform(query, lambda x: F.substring_index(x, "=", 1)),
        "arg": F.transform(query, fold),
    }
    named = [F.array(_named(name)(value)) for name, value in one.items()] + [F.transform(x, _named(name)) for name, x in many.items()]
    return F.array_distinct(F.array_compact(F.concat(*named)))


def _named(name: str) -> Callable[[Column], Column]:
    return lambda value: F.when(value != "", F.concat(F.lit(f"{name}="), value))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """`page_id, tokens, bad` of labelled addresses: bad if the document is toxic or of quality 0."""
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad")
    )
    known = pages.where("page_id is not null").select("page_id", tokens(F.col("url")).alias("tokens"))
    return known.join(judged, F.col("page_id") == F.col("doc_id")).select("page_id", "tokens", "bad")


def baskets(known: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """`item, tokens, freq`: tokens of the same `least` or more addresses; and `items, bad`: all of these that each address of `known` has."""
    rows = known.withColumn("row_", F.monotonically_increasing_id())
    rows = cut_lineage(rows.select("row_", "tokens", "bad"))
    each = rows.select("row_", F.explode("tokens").alias("token"))
    where = [F.sum(F.xxhash64("row_", F.lit(k)).cast("decimal(38,0)")).alias(f"where{k}") for k in range(2)]
    single = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *where).where(F.col("freq") >= least)
    same = single.groupBy("freq", "where0", "where1").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    items = cut_lineage(same.select(F.col("tokens")[0].alias("item"), "tokens", "freq"))
    held = each.join(items.select("item"), F.col("token") == F.col("item")).groupBy("row_").agg(F.collect_list("item").alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return items, cut_lineage(rows.select("row_", "bad").join(held, "row_", "left").select(found.alias("items"), "bad"))


def frequent(rows: DataFrame, least: int, total: int, count: str) -> DataFrame:
    """`held` (in order) and `count`: the sets of items that `least` or more of the `total` rows have, by FP-growth."""
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(rows).freqItemsets
    return sets.select(F.sort_array("items").alias("held"), F.col("freq").alias(count))


def surprise(k: Column, n: Column, share: float) -> Column:
    """n * KL(k/n, share): minus the logarithm of what bounds the probability of k or more of n."""
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(F.lit(0.0))
    return part(k, share) + part(n - k, 1 - share)


def mine(
    pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, chance: float = CHANCE,
    items: int | None = None,
) -> DataFrame:
    """`tokens, key, confidence`: rules that block, filed under the rarest of their tokens. An address is labelled block if
    its document is toxic or of quality 0. `items` once limited the items of an address; all take part now, whatever it says."""
    known = cut_lineage(labelled(pages, labels))
    total, bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    none = pages.sparkSession.createDataFrame([], "tokens array<string>, key string, confidence double")
    if not 0 < bad < total:
        # nothing to tell apart
        return none
    share, enough = bad / total, max(1, math.ceil(min(1.0, max(support, least / total) * (1 - 1e-9)) * total))
    single, rows = baskets(known, enough)
    sets = frequent(rows.select("items"), enough, total, "n")
    tried = max(sets.count(), 1)
    # with k blocked addresses, chance is at most share^k, whatever n is
    needed = max(enough, math.ceil(math.log(tried / chance) / -math.log(share) * (1 - 1e-9)))
    if needed > bad:
        return none
    both = cut_lineage(frequent(rows.where("bad").select("items"), needed, bad, "k"))
    rules = sets.join(both, "held")
    sure = F.col("k") / F.col("n")
    bound = surprise(F.col("k"), F.col("n"), share) >= F.log(F.lit(tried / chance))
    rules = cut_lineage(rules.where((sure >= confidence) & (sure > share) & bound).select("held", sure.alias("confidence")))
    each = rules.select("held", "confidence", F.explode("held").alias("item")).join(single, "item")
    filed = each.groupBy("held", "confidence").agg(
        F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.min(F.struct("freq", "item")).alias("rarest")
    )
    return filed.select("tokens", F.col("rarest.item").alias("key"), "confidence")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`page_id, host, path, rule, verdict, confidence` for every row of `pages`; confidence of the best mined rule."""
    host, path, _ = parts(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
        F.coalesce(tokens(F.col("url")), F.array().cast("array<string>")).alias("tokens"),
    )
    # written, their size is known, so that a small number of rules need not meet the addresses in a shuffle
    index = cut_lineage(rules.withColumnsRenamed({"tokens": "needed"}))
    sets = rows.select("tokens").distinct()
    met = sets.withColumn("key", F.explode("tokens")).join(index, "key").where(F.size(F.array_except("needed", "tokens")) == 0)
    best = cut_lineage(met.groupBy("tokens").agg(F.max("confidence").alias("confidence")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(best, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence"
    )
