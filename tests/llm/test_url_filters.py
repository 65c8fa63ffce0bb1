"""URL filters: fixed rules, and mined rules against a count over all sets of tokens."""

import math
import random
import re
from itertools import combinations

import pytest

from rollcall.llm import queries, url_filters
from tests.conftest import SF

F = url_filters.F
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain(url):
    """Host, path, rule, verdict of the rule."""
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


URLS = [None, "", "x", "http://NET", "http://net/", "http://a.NET/x", "https://example.net/en/1", "https://www.example.net/en", "ftp://q.org/fr/", "http://org/fr/x#y",
        "http://b.example.com/de/?q", "http://u@b.net:80/#q?a", "a://?x/y", "b://c/é d/f.HTML?=1", "http://a://b.net/", "://net/", "http://\nÜ.net/\n/x", "http://xnet/", "http://" + "a/" * 50_000]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)] + [(None, URLS[5], "r", "v")] * 2, "page_id long, url string, rule string, verdict string")
    none = url_filters.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0
    got = url_filters.judge(pages, none).collect()
    want = [(i, *plain(u)) for i, u in enumerate(URLS)] + [(None, *plain(URLS[5]))] * 2
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(((*w[:4], w[4] or "allow") for w in want), key=repr)
    assert url_filters.judge(pages.limit(0), none).count() == 0


def made(spark):
    rows, labels = [], []
    for i in range(600):
        spam = i % 5 == 0
        rows.append((i, f"https://{'win.casino' if spam else 'www.paper'}.io/{'play' if spam or i % 7 == 0 else 'news'}/{i}"))
        if i % 2 == 0 or spam:
            labels.append((i, 1, int(spam and i % 35 != 0)))
    labels += [(5, 0, 0), (5, None, None), (None, 0, 1), (10**6, 0, 1)]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mined_rules(spark):
    """Every set of tokens that is frequent and surprising enough, counted over all sets."""
    pages, labels = made(spark)
    rules = {tuple(r.tokens): r.confidence for r in url_filters.mine(pages, labels, support=0.05, confidence=0.6).collect()}
    rows = {r.page_id: (r.tokens, r.bad) for r in url_filters.labelled(pages, labels).collect()}
    total, bad = len(rows), sum(b for _, b in rows.values())
    holders = {}
    for i, (found, _) in rows.items():
        for t in found:
            holders.setdefault(t, set()).add(i)
    # tokens of the same addresses are one item
    items = {}
    for t, ids in holders.items():
        if len(ids) >= 5:
            items.setdefault(frozenset(ids), []).append(t)
    counts, tried, want = {}, 0, {}
    for n in range(1, len(items) + 1):
        for some in combinations(items, n):
            counts[some] = ids = frozenset.intersection(*some)
            tried += len(ids) >= 0.05 * total
    for some, ids in counts.items():
        k, n = sum(rows[i][1] for i in ids), len(ids)
        if k >= 0.05 * total and k / n >= 0.6:
            part = lambda x, p: x * math.log(x / (n * p)) if x else 0.0
            if part(k, bad / total) + part(n - k, 1 - bad / total) >= math.log(tried / 0.01):
                want[tuple(sorted(t for one in some for t in items[one]))] = k / n
    assert rules.keys() == want.keys() and len(want) >= 3 and all(math.isclose(rules[k], want[k]) for k in want)


def labelled_table(spark, n, url, bad):
    rows = [(i, url(i)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(
        [(i, 1, int(bad(i))) for i in range(n)], "doc_id long, quality int, toxic int"
    )


@pytest.mark.parametrize("n", [20, 100, 1000, 5000])
def test_random_labels_give_no_rule(spark, n):
    r = random.Random(n)
    words = [f"w{i}" for i in range(12)]
    urls = ["/".join([f"https://{r.choice(words)}.{r.choice(words)}.net", r.choice(words), f"{i % 7}"]) + f"?{r.choice(words)}={r.choice(words)}" for i in range(n)]
    toxic = [r.random() < 0.2 for _ in range(n)]
    pages, labels = labelled_table(spark, n, urls.__getitem__, toxic.__getitem__)
    assert url_filters.mine(pages, labels).count() == 0


@pytest.mark.parametrize("place", ["https://a.b.io/en/{0}/x/casino/win{0}", "http://a.io/?id={0}&page=2&affid={0}", "http://x{0}.bets.example.com/q"])
def test_rules_are_found_in_any_place(spark, place):
    """A late path segment, a later query key, a label in the middle of the host."""
    r = random.Random(1)
    spam = [r.random() < 0.15 for _ in range(600)]
    other = ["https://a.b.io/en/{0}/x/news/{0}", "http://a.io/?id={0}&page=2", "http://x{0}.shop.example.com/q"]
    pages, labels = labelled_table(spark, 600, lambda i: (place if spam[i] else r.choice(other)).format(i), lambda i: spam[i] and r.random() < 0.9)
    rules = url_filters.mine(pages, labels)
    verdicts = {x.page_id: x.verdict for x in url_filters.judge(pages, rules).collect()}
    assert [verdicts[i] == "block" for i in range(600)] == spam
    new = spark.createDataFrame([(1, place.format(98765)), (2, other[0].format(98765))], "page_id long, url string")
    assert [x.verdict for x in url_filters.judge(new, rules).orderBy("page_id").collect()] == ["block", "allow"]


def test_tokens_of_any_place(spark):
    url = "https://a.bets.b.example.com/en/12/casino.php?id=1&affid=x7&id=1#top"
    got = spark.createDataFrame([(url,)], "url string").select(url_filters.tokens(F.col("url"))).first()[0]
    assert sorted(got) == sorted([
        "scheme=https", "host=a.bets.b.example.com", "depth=3", "ends=php", "fragment=top", "label=a", "label=bets", "label=b", "label=example", "label=com",
        "step=en", "step=0", "step=casino.php", "key=id", "key=affid", "arg=id=0", "arg=affid=x0",
    ])


def test_addresses_of_many_parts(spark):
    """Forty parts that all addresses share are one item, and of an address with many items the rarest are mined."""
    r = random.Random(2)
    fixed = "/".join(f"p{i}q" for i in range(20))
    pages, labels = labelled_table(spark, 400, lambda i: f"http://h.net/{fixed}?" + "&".join(f"k{j}x" for j in range(40) if r.random() < 0.5) + ("&bad" if i % 8 == 0 else ""), lambda i: i % 8 == 0)
    rules = url_filters.mine(pages, labels, items=8)
    assert any(x.tokens == ["arg=bad", "key=bad"] for x in rules.collect())


def test_common_parts_of_addresses_of_many_parts(spark):
    """Addresses of about twenty items each, and a rule over the two that are in more addresses than any other."""
    r = random.Random(3)
    others = [c + d for c in "cdefghij" for d in "klmno"]
    keys = [[k for k in others if r.random() < 0.5] + [k for k in "ab" if r.random() < 0.6] for _ in range(400)]
    bad = [{"a", "b"} <= set(k) for k in keys]
    assert min(keys, key=len) and sum(len(k) > 14 for k in keys) > 350
    pages, labels = labelled_table(spark, 400, lambda i: "http://h.net/?" + "&".join(keys[i]), bad.__getitem__)
    rules = {tuple(x.tokens): x.confidence for x in url_filters.mine(pages, labels, support=0.1).collect()}
    assert rules[("arg=a", "arg=b", "key=a", "key=b")] == 1.0
    for third in others:
        held = sum(b and third in k for b, k in zip(bad, keys, strict=True))
        assert ((tuple(sorted(f"{p}={k}" for p in ("arg", "key") for k in ("a", "b", third)))) in rules) == (held >= 40)


def test_inverted_index_finds_what_containment_does(spark):
    pages, labels = made(spark)
    rules = url_filters.mine(pages, labels, support=0.05, confidence=0.6)
    tokens = {r.page_id: set(r.tokens) for r in pages.select("page_id", url_filters.tokens(F.col("url")).alias("tokens")).collect()}
    plain_rules = [(set(r.tokens), r.confidence) for r in rules.collect()]
    got = {r.page_id: (r.verdict, r.confidence) for r in url_filters.judge(pages, rules).collect()}
    for i, mine in tokens.items():
        best = max((c for t, c in plain_rules if t <= mine), default=None)
        assert got[i] == ("allow" if best is None else "block", best)
    assert any(v == "block" for v, _ in got.values())


def test_the_table(spark):
    got = {r.page_id: r for r in queries.op8_url_filters(spark, SF).collect()}
    for p in queries.table(spark, SF, "pages").collect():
        host, path, rule, verdict = plain(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
