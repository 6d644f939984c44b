"""URL filters by a path-template tree.

1. A url's path becomes a shape: its segments, digits as "*". Shapes are counted per host, with how many of
   their pages the rules block and allow, before anything is shuffled.
2. From the top: at a node of which the segments are many and rare, they become "*".
3. From the bottom: siblings merge into "*" where neither what follows them nor their labels differ from
   the node's as a whole (two chi-square statistics). A branch is held against the node's pooled
   counts, never against each of its siblings, so no node's branches are gathered.
4. What is left of a shape is its template. A template with blocked pages is rejected if their smoothed
   share is high; pages that no rule decides count in part towards the share of all hosts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments of a shape; what follows the last is "**".
DEPTH = 8
#: A node's segments are variable from so many on, with less than so many pages each.
LEAST_KINDS, FEW_PAGES = 8, 3
#: Standard deviations above its mean at which a statistic tells branches apart.
DEVIATIONS = 3.0
#: Labels that the overall share stands for in each template, what an undecided page counts, and the share at which a template is rejected.
PRIOR, UNDECIDED, PURITY = 1.0, 0.25, 0.9
#: Tables are broadcast up to so many rows, by a count.
BROADCAST = 100_000
CLOSE = 1e-6


class Rule(NamedTuple):
    """Decides the urls of a host and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, A to Z in lower case, and the path of a url; both empty where it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits columns host and path (ties: the first by text), null if none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), [-ord(c) for c in r.host + r.path])):  # the strongest last, so outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def parsed(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruling and shape of every page."""
    host, path = host_and_path()
    parts = F.split(F.regexp_replace("path", "[0-9]+", "*"), "/")
    shape = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.lit("**")))).otherwise(parts)
    rule, ruling = ruled(rules)
    return pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), ruling.alias("ruling"), F.array_join(shape, "/").alias("shape"))


def _beside(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """A left join with a written table of which the size is counted first: broadcast if small, else dealt by key, where adaptive execution splits hot ones."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST + 1).count() <= BROADCAST else few, on, "left")


def _with_segment(segments: str, k: int, when: Column) -> Column:
    """The array with "*" at place k (from 0) where `when` holds."""
    return F.transform(segments, lambda x, i: F.when((i == k) & when, "*").otherwise(x))


def _generalised(rows: DataFrame, k: int) -> DataFrame:
    """Segments at place k as "*" under nodes where they are many and rare."""
    rows = rows.withColumn("above", F.array_join(F.slice("segments", 1, k), "/")).withColumn("own", F.get("segments", F.lit(k)))
    kinds = rows.where("own is not null").groupBy("host", "above", "own").agg(F.sum("n").alias("n"))
    nodes = kinds.groupBy("host", "above").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    loose = written(nodes.where((F.col("kinds") >= LEAST_KINDS) & (F.col("n") < FEW_PAGES * F.col("kinds"))).select("host", "above", F.lit(True).alias("loose")))
    return written(_beside(rows, loose, ["host", "above"]).withColumn("segments", _with_segment("segments", k, F.coalesce("loose", F.lit(False)))).drop("above", "own", "loose"))


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """Branches at place k as "*" where two or more of a node's are like the node as a whole. `made` has the segments of the template from k + 1 on."""
    follows = F.array_join(F.slice("made", k + 2, DEPTH), "/")
    below = F.when(F.size("made") > k + 1, F.concat(F.lit("/"), follows)).otherwise("")
    rows = rows.withColumn("above", F.array_join(F.slice("segments", 1, k), "/")).withColumn("own", F.get("segments", F.lit(k)))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    kinds = written(rows.where("own is not null").withColumn("below", below).groupBy("host", "above", "own", "below").agg(*sums))
    pooled = kinds.groupBy("host", "above", "below").agg(F.sum("n").alias("pool_n"))
    branches = kinds.groupBy("host", "above", "own").agg(F.sum("n").alias("own_n"), F.sum("blocked").alias("own_blocked"), F.sum("allowed").alias("own_allowed"))
    nodes = branches.groupBy("host", "above").agg(F.sum("own_n").alias("all_n"), F.sum("own_blocked").alias("all_blocked"), F.sum("own_allowed").alias("all_allowed"), F.count("*").alias("branches")).where("branches > 1")
    nodes = nodes.join(pooled.groupBy("host", "above").agg(F.count("*").alias("kinds")), ["host", "above"])
    held = branches.join(nodes, ["host", "above"]).withColumnRenamed("own_n", "n")
    shape = kinds.select("host", "above", "own", "below", F.col("n").alias("part")).join(pooled, ["host", "above", "below"])
    shape = shape.groupBy("host", "above", "own").agg(F.sum(F.col("part") * F.col("part") / F.col("pool_n")).alias("squares"))
    free = F.col("kinds") - 1
    told = F.col("squares") * F.col("all_n") / F.col("n") - F.col("n")
    labelled, all_labelled = F.col("own_blocked") + F.col("own_allowed"), F.col("all_blocked") + F.col("all_allowed")
    square = lambda own, every: F.when(F.col(every) > 0, F.col(own) * F.col(own) / F.col(every)).otherwise(F.lit(0.0))
    labels = F.when(labelled > 0, (square("own_blocked", "all_blocked") + square("own_allowed", "all_allowed")) * all_labelled / labelled - labelled).otherwise(F.lit(0.0))
    like = (told <= free + DEVIATIONS * F.sqrt(2.0 * free) + CLOSE) & (labels <= 1 + DEVIATIONS * F.sqrt(F.lit(2.0)))
    alike = held.join(shape, ["host", "above", "own"]).where(like).select("host", "above", "own")
    several = alike.groupBy("host", "above").agg(F.count("*").alias("alike")).where("alike > 1").select("host", "above")
    joins = written(alike.join(several, ["host", "above"]).withColumn("joins", F.lit(True)))
    return written(_beside(rows, joins, ["host", "above", "own"]).withColumn("made", _with_segment("made", k, F.coalesce("joins", F.lit(False)))).drop("above", "own", "joins"))


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, template, n, blocked, allowed and rejected of every shape of parsed pages; the numbers are the template's."""
    of = lambda v: F.count_if(F.col("ruling") == v)
    counted = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), of("block").alias("blocked"), of("allow").alias("allowed"))
    rows = written(counted.withColumn("segments", F.split("shape", "/")))
    most, blocked, allowed = rows.agg(F.coalesce(F.max(F.size("segments")), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    for k in range(most):
        rows = _generalised(rows, k)
    rows = rows.withColumn("made", F.col("segments"))
    for k in reversed(range(most)):
        rows = _merged(rows, k)
    rows = rows.withColumn("template", F.array_join("made", "/"))
    share = blocked / (blocked + allowed) if blocked + allowed else 0.5
    labelled = F.col("blocked") + F.col("allowed")
    unknown = PRIOR + UNDECIDED * (F.col("n") - labelled)
    purity = (F.col("blocked") + unknown * share) / (labelled + unknown)
    sums = rows.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed"))).withColumn("rejected", (F.col("blocked") > 0) & (purity >= PURITY))
    return rows.select("host", "shape", "template").join(sums, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page, by its url.

    The longest rule that fits decides; else a page is blocked where its template is rejected. A null
    url, or one without "://", has an empty host and path, and a template of its own. Urls are judged
    whole; repeated rows count as often as they occur and get one verdict. An empty table gives no
    rows; other columns are ignored.
    """
    rows = parsed(pages, rules)
    learned = written(templates(rows).select("host", "shape", "template", "rejected"))
    verdict = F.coalesce("ruling", F.when(F.col("rejected"), "block").otherwise("allow"))
    return _beside(rows, learned, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def oracle() -> str:
    """The same rows of `pages` in DuckDB, a level of the tree after the other."""
    ordered = sorted(RULES, key=lambda r: (len(r.host) + len(r.path), [-ord(c) for c in r.host + r.path]), reverse=True)
    fits = [f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then " for r in ordered]
    rule, ruling = (f"case {' '.join(f + repr(say(r)) for f, r in zip(fits, ordered))} end" for say in (lambda r: r.host + r.path, lambda r: r.verdict))
    out = f"""
with rests as (
  select page_id, case when instr(url, '://') > 0 then url[instr(url, '://') + 3 :] else '' end as rest from pages
), sites as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests
), parts as (
  select *, {rule} as rule, {ruling} as ruling, string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/') as all_parts from sites
), parsed as (
  select *, case when len(all_parts) > {DEPTH} then list_append(all_parts[1:{DEPTH - 1}], '**') else all_parts end as shape from parts
), g0 as (
  select host, shape, shape as segments, count(*) as n, count(*) filter (ruling = 'block') as blocked, count(*) filter (ruling = 'allow') as allowed from parsed group by host, shape
)"""
    star = lambda column, k, when: f"case when {when} then list_concat(list_append({column}[1:{k}], '*'), {column}[{k + 2}:]) else {column} end"
    for k in range(DEPTH):
        out += f""", kinds{k} as (
  select host, segments[1:{k}] as above, segments[{k + 1}] as own, sum(n) as n from g{k} where len(segments) > {k} group by all
), loose{k} as (
  select host, above from kinds{k} group by all having count(*) >= {LEAST_KINDS} and sum(n) < {FEW_PAGES} * count(*)
), g{k + 1} as (
  select g.host, shape, {star("segments", k, f"l.host is not null and len(segments) > {k}")} as segments, n, blocked, allowed
  from g{k} g left join loose{k} l on l.host = g.host and l.above = g.segments[1:{k}]
)"""
    out += f", m{DEPTH} as (select *, segments as made from g{DEPTH})"
    for k in reversed(range(DEPTH)):
        out += f""", parts{k} as (
  select host, segments[1:{k}] as above, segments[{k + 1}] as own, made[{k + 2}:] as below, sum(n) as n, sum(blocked) as blocked, sum(allowed) as allowed from m{k + 1} where len(segments) > {k} group by all
), pools{k} as (
  select host, above, below, sum(n) as pool_n from parts{k} group by all
), nodes{k} as (
  select host, above, sum(n) as all_n, sum(blocked) as all_blocked, sum(allowed) as all_allowed, count(distinct below) as kinds from parts{k} group by all having count(distinct own) > 1
), branches{k} as (
  select p.host, p.above, p.own, sum(p.n) as n, sum(blocked) as blocked, sum(allowed) as allowed, sum(cast(p.n as double) * p.n / pool_n) as squares from parts{k} p join pools{k} using (host, above, below) group by all
), alike{k} as (
  select b.host, b.above, own from branches{k} b join nodes{k} using (host, above)
  where squares * all_n / n - n <= kinds - 1 + {DEVIATIONS} * sqrt(2.0 * (kinds - 1)) + {CLOSE}
    and (blocked + allowed = 0 or (case when all_blocked > 0 then cast(blocked as double) * blocked / all_blocked else 0 end + case when all_allowed > 0 then cast(allowed as double) * allowed / all_allowed else 0 end) * (all_blocked + all_allowed) / (blocked + allowed) - (blocked + allowed) <= 1 + {DEVIATIONS} * sqrt(2.0))
), joins{k} as (
  select * from alike{k} where (host, above) in (select (host, above) from alike{k} group by host, above having count(*) > 1)
), m{k} as (
  select m.host, shape, segments, n, blocked, allowed, {star("made", k, f"j.host is not null and len(segments) > {k}")} as made
  from m{k + 1} m left join joins{k} j on j.host = m.host and j.above = m.segments[1:{k}] and j.own = m.segments[{k + 1}]
)"""
    return f"""{out}, overall as (
  select coalesce(cast(sum(blocked) as double) / nullif(sum(blocked) + sum(allowed), 0), 0.5) as share from g0
), sums as (
  select host, made, sum(n) as n, sum(blocked) as blocked, sum(allowed) as allowed from m0 group by all
), rejected as (
  select host, made from sums, overall
  where blocked > 0 and (blocked + ({PRIOR} + {UNDECIDED} * (n - blocked - allowed)) * share) / (blocked + allowed + {PRIOR} + {UNDECIDED} * (n - blocked - allowed)) >= {PURITY}
)
select page_id, p.host, path, rule, coalesce(ruling, case when r.host is null then 'allow' else 'block' end) as verdict, array_to_string(m.made, '/') as template
from parsed p join m0 m on m.host = p.host and m.shape = p.shape left join rejected r on r.host = m.host and r.made = m.made
"""
