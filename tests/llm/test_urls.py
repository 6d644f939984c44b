"""Verdicts and templates against a plain tree, parsing against plain text."""

import collections
import math
import random
import re

import pytest

from calorant.llm import urls

RULES = {r.host + r.path: r for r in urls.RULES}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(url):
    _, there, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest).group() if there else ""
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :]).group() if there else ""


def rule(host, path):
    fits = [t for t, r in RULES.items() if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=len, default=None)


def brute(pages):
    """page_id, host, path, rule, verdict and template."""
    shapes = collections.defaultdict(lambda: [0, 0, 0])
    rows = []
    for page_id, url in pages:
        host, path = split(url)
        parts = re.sub("[0-9]+", "*", path).split("/")
        shape = tuple(parts if len(parts) <= urls.DEPTH else [*parts[: urls.DEPTH - 1], "**"])
        said = rule(host, path)
        rows.append((page_id, host, path, said, shape))
        own = shapes[host, shape]
        own[0] += 1
        if said:
            own[1 if RULES[said].verdict == "block" else 2] += 1
    above = {k: list(k[1]) for k in shapes}
    for d in range(urls.DEPTH):
        nodes = collections.defaultdict(collections.Counter)
        for k, s in above.items():
            if len(s) > d:
                nodes[k[0], tuple(s[:d])][s[d]] += shapes[k][0]
        for k, s in above.items():
            kinds = nodes[k[0], tuple(s[:d])]
            if len(s) > d and len(kinds) >= urls.LEAST_KINDS and sum(kinds.values()) < urls.FEW_PAGES * len(kinds):
                s[d] = "*"
    made = {k: list(s) for k, s in above.items()}
    for d in reversed(range(urls.DEPTH)):
        nodes = collections.defaultdict(lambda: collections.defaultdict(list))
        for k, s in above.items():
            if len(s) > d:
                nodes[k[0], tuple(s[:d])][s[d]].append(k)
        for branches in nodes.values():
            if len(branches) > 1:
                alike = [b for b in branches if like(branches, b, shapes, made, d)]
                if len(alike) > 1:
                    changed = [k for b in alike for k in branches[b]]
                    for k in changed:
                        made[k] = [*made[k][:d], "*", *made[k][d + 1 :]]
    total = [sum(v[i] for v in shapes.values()) for i in range(3)]
    share = total[1] / (total[1] + total[2]) if total[1] + total[2] else 0.5
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for k, v in shapes.items():
        own = sums[k[0], tuple(made[k])]
        for i in range(3):
            own[i] += v[i]

    def rejected(t):
        n, blocked, allowed = sums[t]
        unknown = urls.PRIOR + urls.UNDECIDED * (n - blocked - allowed)
        return blocked > 0 and (blocked + unknown * share) / (blocked + allowed + unknown) >= urls.PURITY

    return sorted(((p, h, path, r, RULES[r].verdict if r else "block" if rejected((h, tuple(made[h, s]))) else "allow", "/".join(made[h, s])) for p, h, path, r, s in rows), key=str)


def like(branches, b, shapes, made, d):
    def counts(keys):
        below, labels = collections.Counter(), [0, 0]
        for k in keys:
            below[tuple(made[k][d + 1 :])] += shapes[k][0]
            labels = [labels[0] + shapes[k][1], labels[1] + shapes[k][2]]
        return below, labels

    every, labels = counts([k for own in branches.values() for k in own])
    own, mine = counts(branches[b])
    n, total = sum(own.values()), sum(every.values())
    told = sum((v - n * every[s] / total) ** 2 / (n * every[s] / total) for s, v in ((s, own[s]) for s in every))
    free = len(every) - 1
    if told > free + urls.DEVIATIONS * math.sqrt(2 * free) + urls.CLOSE:
        return False
    if not sum(mine):
        return True
    expected = [sum(mine) * x / sum(labels) for x in labels]
    return sum((x - e) ** 2 / e for x, e in zip(mine, expected) if e) <= 1 + urls.DEVIATIONS * math.sqrt(2)


def got(df):
    return sorted((tuple(r) for r in urls.judge(df).collect()), key=str)


def made_urls(seed, n):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.example.com", "example.net", "x.net", "c.example.org", "plain.org", "UPPER.example.COM"]
    out = []
    for i in range(n):
        lang = rng.choice(["de", "de", "de", "en", "fr"]) if rng.random() < 0.9 else f"slug{rng.choice('abcdefghijklmnop')}{rng.choice('qrstuvw')}"
        tail = rng.choice([f"{i}", f"{i}.html", f"{i}/", f"post-{rng.choice('abcdefghijk')}{rng.choice('abcdefghijk')}/{i}", "", "a/b/c/d/e/f/g/h/i/j"])
        out.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{lang}/{tail}{rng.choice(['', '?q=a/b#c', '#top'])}"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_equal_a_plain_tree(spark, seed):
    pages = made_urls(seed, 400)
    want = brute(pages)
    assert got(spark.createDataFrame(pages, "page_id long, url string").repartition(3)) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}  # the method decides both ways


def test_awkward_urls_have_a_result(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme/en/1"), (4, "://"), (5, "x://H\u00c9.Net"), (6, "http://net/"), (7, "http://net"), (8, "http://anet/"), (9, "a://b://c/d"), (10, "http://Example.NET/en/"), (10, "http://Example.NET/en/"),
        (None, "http://example.net/en"), (11, "http://h/\n?x"), (12, "http://h/" + "s/" * 5000), (13, "http://w.org/fr/a?http://x.net/"), (14, "http://example.com:80/de/"), (15, "http://h?a/b"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n", "2 AS shape", "3 AS segments").repartition(2)
    assert got(df) == brute(pages)
    assert got(df.limit(0)) == []
    by = {r[0]: r for r in got(df)}
    assert by[1][1:4] == ("", "", None) and by[5][1] == "h\u00c9.net" and by[7][2:4] == ("", None) and by[8][3] is None and by[10][3] == "example.net/en/" and by[9][1:3] == ("b:", "//c/d")
