"""Validation of feeds in ordered passes: every line is accepted, quarantined with its issues, or a replay.

A pass works on all rows at once and depends on the issues that the passes before it found. Rows are
brought together by pre-aggregated joins, so that a repeated key is never gathered in one task. Passes
carry cells, the few columns of a row that they read, and deal out only what shares a value with other
rows. Cells are written once between passes, which keeps plans short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from calorant.functions.keys import percent_encoded
from calorant.operators import ranges
from calorant.plans.folders import settled
from calorant.sources.contracts import CONTRACTS, Contract
from calorant.sources.jsonlines import fields, is_number, numbered, objects, text_of

Feeds = dict[str, DataFrame]
INTERVALS = ("commitment_schedule", "approved_excess_order", "delivery_point_capacity_assessment")
EFFECTIVE = ("customer_master", "industrial_site_master", "delivery_point_assignment", "revenue_meter_assignment", "contract_terms")
#: Overlap rules in their order: feed, group, code. Only authoritative meters take part.
OVERLAPS = [
    ("customer_master", ["customer_natural_id"], "customer_effective_overlap"),
    ("industrial_site_master", ["site_natural_id"], "site_effective_overlap"),
    ("delivery_point_assignment", ["delivery_point_natural_id"], "delivery_point_assignment_overlap"),
    ("delivery_point_assignment", ["site_natural_id"], "site_delivery_point_overlap"),
    ("revenue_meter_assignment", ["meter_natural_id", "register_natural_id"], "meter_assignment_overlap"),
    ("revenue_meter_assignment", ["delivery_point_natural_id"], "delivery_point_meter_overlap"),
    ("contract_terms", ["delivery_point_natural_id"], "contract_terms_overlap"),
]
#: Fields that rules within a row read and that may be absent.
READ = ("effective_to_utc", "nameplate_ceiling_mwh_th", "operational_restriction_mwh_th", "deliverable_capacity_mwh_th")
#: Fields that the passes read beside those, keys of episodes and opaque ids.
JUDGED = (
    "customer_natural_id", "site_natural_id", "delivery_point_natural_id", "meter_natural_id", "register_natural_id", "contract_natural_id", "effective_from_utc", "interval_start_utc", "interval_end_utc", "reading_at_utc",
    "approval_state", "version_record_status", "assignment_status", "terms_status", "schedule_record_status", "lifecycle_status", "operational_status", "assignment_role", "obligation_status", "committed_mwh_th", "register_type", "native_unit",
)
CLEAN = "size(issues) = 0"
VALID = f"{CLEAN} and not replay"
#: Shared values are broadcast up to this many.
FEW = 20_000
PUBLISHED = ("accepted", "lines", "quarantined", "replays", "report")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files with line_number, and a locator (file and number) whose order is the lines'."""
    place = F.concat_ws(":", "file", F.lpad(F.col("line_number").cast("string"), 14, "0"))
    return numbered(spark, path).select(place.alias("locator"), "line_number", "line")


def read_bundle(spark: SparkSession, folder: str, names: dict[str, str] | None = None) -> tuple[Feeds, DataFrame]:
    """Lines of the files that a folder holds, by feed, and issues (feed, code) of the bundle.

    names: the file of each feed, <feed>.jsonl unless given. A feed without a name is dataset_missing, one
    whose file isn't there dataset_file_missing, and one that no contract knows unsupported_dataset. A file
    without lines is there, and counts as empty.
    """
    names = {feed: f"{feed}.jsonl" for feed in CONTRACTS} if names is None else names
    lines: Feeds = {}
    issues = [(feed, "unsupported_dataset") for feed in sorted(set(names) - set(CONTRACTS))] + [(feed, "dataset_missing") for feed in CONTRACTS if feed not in names]
    for feed in CONTRACTS:
        if feed in names:
            try:
                lines[feed] = read_lines(spark, f"{folder}/{names[feed]}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                issues.append((feed, "dataset_file_missing"))
    return lines, spark.createDataFrame(issues, "feed string, code string")


def issued(df: DataFrame, codes: Column) -> DataFrame:
    """df with further issue codes (an array; null counts as none), each once."""
    return df.withColumn("issues", F.array_union("issues", F.coalesce(codes, F.array().cast("array<string>"))))


def _when(rules: dict[str, Column]) -> Column:
    """The codes whose rules hold. The list is made only where one does, as its functions are not compiled."""
    none = F.array().cast("array<string>")
    return F.when(_any(rules), _list(rules)).otherwise(none) if rules else none


def _any(rules: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, rules.values(), F.lit(False))


def _list(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda c: c.isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many partitions as the cluster has cores, if they are in fewer: a small file is one split."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


def parsed(lines: DataFrame, feed: str, contract: Contract) -> DataFrame:
    """Typed rows of lines (locator, line, and other columns as they are): issues of the file and schema passes, broken fields and rules as failures.

    payload_sha256 is of the object's canonical form; an explicit null and an absent key differ, and so do
    1 and 1.0. An identity needs each of its fields.
    """
    keys = ("source_system_id", *contract.episode, "source_revision")
    df = fields(spread(lines), list(dict.fromkeys([*(f.name for f in contract.fields), *keys]))).withColumnRenamed("issue", "_file")
    if texts := {k: c for f in contract.fields for k, c in f.texts().items()}:
        df = df.withColumns(texts)
    df = df.withColumns({f.name: f.value() for f in contract.fields})
    unread = _when({f.name: F.col(f.name).isNull() & (f.token != "null") for f in contract.fields if f.name in READ})
    df = df.withColumn("unread", unread)
    rules = {f.name: f.broken() for f in contract.fields} | {f"rule {name}": F.expr(rule) for name, rule in contract.rules.items()}
    others = {k: F.col(f"_token_{k}").isNotNull() for k in keys if k not in {f.name for f in contract.fields}}
    unknown = F.concat("others", _when(others))
    failed = F.col("_file").isNull() & F.coalesce(_any(rules) | _any(others) | (F.size("others") > 0), F.lit(False))
    df = df.withColumn("_failed", failed)
    df = df.withColumn("failures", F.when(F.col("_file").isNull(), F.concat(_when(rules), F.transform(unknown, lambda k: F.concat(F.lit("unknown "), k)))))
    own = lambda name: F.col(f"_token_{name}")
    said = lambda t: F.coalesce(text_of(t), F.when(t == "true", "True").when(t == "false", "False").when(t == "null", "None").when(is_number(t), t))
    identity = F.concat(F.lit(feed), *(F.concat(F.lit(f"::{name}="), percent_encoded(said(own(name)))) for name in keys))
    schema = {"payload_not_canonical_json": F.col("payload_sha256").isNull(), "schema_validation_failed": F.col("_failed")}
    df = df.withColumns({"identity": identity, "replay": F.lit(False)})
    unnamed = F.when(F.col("identity").isNull(), F.array(F.lit("identity_not_computable"))).otherwise(F.array().cast("array<string>"))
    issues = F.when(F.col("_file").isNotNull(), F.array("_file")).when(_any(schema), _list(schema)).otherwise(unnamed)
    return df.withColumn("issues", issues).drop("others", "_file", "_failed", *(c for c in df.columns if c.startswith(("_token_", "_text_"))))


def _shared(df: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """Rows whose values of columns others may share, and how many such values there are (more than FEW are not counted): only hashes of all values are dealt out."""
    own = F.xxhash64(*columns)
    several = settled(df.groupBy(own.alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "shared")
    n = several.limit(FEW + 1).count()
    return df.withColumn("_hash", own).join(_few(several, n), "_hash", "left_semi").drop("_hash"), n


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def unduplicated(df: DataFrame) -> DataFrame:
    """Rows of one identity: a conflict if payloads differ, else all but the first are replays, with its accepted_locator."""
    rows, n = _shared(df.where(CLEAN).select("identity", "payload_sha256", "locator"), "identity")
    sound = rows.groupBy("identity").agg(F.min("payload_sha256").alias("_low"), F.max("payload_sha256").alias("_high"), F.min("locator").alias("_first"))
    df = df.join(_few(sound, n), "identity", "left").withColumn("_ok", F.expr(CLEAN) & F.col("_first").isNotNull())
    df = issued(df, F.when(F.col("_ok") & (F.col("_low") != F.col("_high")), F.array(F.lit("source_revision_conflict"))))
    df = df.withColumn("replay", F.expr(CLEAN) & F.col("_ok") & (F.col("locator") != F.col("_first")))
    return df.withColumn("accepted_locator", F.when(F.col("replay"), F.col("_first"))).drop("_low", "_high", "_first", "_ok")


def opaque_once(df: DataFrame, opaque: str) -> DataFrame:
    """An opaque id that stands for several identities."""
    rows, n = _shared(_valid(df).select(opaque, "identity"), opaque)
    if not n:
        return df
    many = rows.groupBy(opaque).agg(F.min("identity").alias("_a"), F.max("identity").alias("_b")).where("_a <> _b").select(opaque, F.lit(True).alias("_many"))
    df = df.join(_few(many, n), opaque, "left")
    return issued(df, F.when(F.expr(CLEAN) & ~F.col("replay") & F.col("_many"), F.array(F.lit("opaque_revision_id_reused")))).drop("_many")


def local(df: DataFrame, feed: str) -> DataFrame:
    """Rules within a row: intervals of half an hour on the half hour, periods forward, capacity arithmetic.

    A row whose line has a value that a rule needs and can't read, or lacks an instant, fails closed as
    business_rule_value_invalid: its contract should have found that before.
    """
    rules: dict[str, Column] = {}
    given = (lambda n: F.array_contains("unread", n)) if "unread" in df.columns else lambda n: F.col(n).isNull() & F.get_json_object("line", f"$.{n}").isNotNull()
    unread = lambda *names: reduce(lambda a, b: a | b, map(given, names))
    invalid: list[Column] = []
    if feed in INTERVALS:
        invalid += [F.col("interval_start_utc").isNull() | F.col("interval_end_utc").isNull()]
        rules["interval_not_30_minutes"] = F.expr("interval_end_utc <> interval_start_utc + interval 30 minutes")
        rules["interval_not_half_hour_aligned"] = F.expr("date_format(interval_start_utc, 'mm:ss.SSSSSS') not in ('00:00.000000', '30:00.000000')")
    if feed in EFFECTIVE:
        invalid += [F.col("effective_from_utc").isNull() | unread("effective_to_utc")]
        rules["invalid_effective_period"] = F.expr("effective_from_utc >= effective_to_utc")
    if feed == "delivery_point_capacity_assessment":
        invalid += [unread("nameplate_ceiling_mwh_th", "operational_restriction_mwh_th", "deliverable_capacity_mwh_th")]
        rules["capacity_arithmetic_mismatch"] = F.expr("deliverable_capacity_mwh_th <> greatest(nameplate_ceiling_mwh_th - operational_restriction_mwh_th, 0)")
    if invalid:
        rules["business_rule_value_invalid"] = reduce(lambda a, b: a | b, invalid)
    return issued(df, F.when(F.expr(CLEAN) & ~F.col("replay"), _when(rules))) if rules else df


def _valid(df: DataFrame) -> DataFrame:
    return df.where(VALID)


def newest(df: DataFrame, episode: list[str]) -> DataFrame:
    """df with newest: whether a row is of its episode's greatest revision; rows without an identity and replays are of none."""
    held = df.where("identity is not null and not replay")
    rows, n = _shared(held.select(*episode, "source_revision"), *episode)
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("identity", *episode, "source_revision")], ~F.col("replay"))
    if not n:
        return df.withColumn("newest", there)
    greatest = rows.groupBy(*episode).agg(F.max("source_revision").alias("_greatest"))
    df = df.join(_few(greatest, n), episode, "left")
    return df.withColumn("newest", there & (F.col("_greatest").isNull() | (F.col("source_revision") == F.col("_greatest")))).drop("_greatest")


def _referring(df: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Issues of valid rows whose keys no valid parent has: code -> (parents, column)."""
    for code, (parents, column) in references.items():
        df = df.join(_valid(parents).select(column).distinct().withColumn(f"_{code}", F.lit(True)), column, "left")
    found = F.when(F.expr(CLEAN) & ~F.col("replay"), _when({code: F.col(f"_{code}").isNull() for code in references}))
    return issued(df, found).drop(*(f"_{code}" for code in references))


def references(feeds: Feeds) -> Feeds:
    """Assignments need customers and sites; meters and contracts need the assignments left valid by that."""
    out = dict(feeds)
    customers, sites = (feeds["customer_master"], "customer_natural_id"), (feeds["industrial_site_master"], "site_natural_id")
    out["delivery_point_assignment"] = settled(_referring(feeds["delivery_point_assignment"], {"customer_reference_missing": customers, "site_reference_missing": sites}))
    points = (out["delivery_point_assignment"], "delivery_point_natural_id")
    out["revenue_meter_assignment"] = settled(_referring(feeds["revenue_meter_assignment"], {"delivery_point_reference_missing": points}))
    out["contract_terms"] = settled(_referring(feeds["contract_terms"], {"delivery_point_reference_missing": points, "customer_reference_missing": customers}))
    return out


def current(df: DataFrame, feed: str) -> DataFrame:
    """Rows in force: of each episode those of the greatest revision, if they are valid, approved and active."""
    return df.where("newest").where(CLEAN).where("approval_state = 'approved'").where(CONTRACTS[feed].active)


def overlaps(feeds: Feeds) -> Feeds:
    """Rows in force that overlap another of their group. Later rules leave out what earlier ones found. A group of one row overlaps nothing."""
    out = dict(feeds)
    for feed, group, code in OVERLAPS:
        rows = current(out[feed], feed)
        if feed == "revenue_meter_assignment":
            rows = rows.where("assignment_role = 'authoritative_revenue'")
        rows, n = _shared(rows.select("locator", *group, "effective_from_utc", "effective_to_utc"), *group)
        if n:
            found = ranges.overlapping(rows, group, "effective_from_utc", "effective_to_utc", "locator").select("locator", F.lit(True).alias("_found"))
            out[feed] = settled(issued(out[feed].join(found, "locator", "left"), F.when(F.col("_found"), F.array(F.lit(code)))).drop("_found"))
    return out


def _several(versions: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Keys that have several versions, and how many (more than FEW are not counted)."""
    several = settled(versions.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "several")
    return several, several.limit(FEW + 1).count()


def _covering(df: DataFrame, versions: DataFrame, keys: list[str], take: list[str], name: str, match: Column) -> DataFrame:
    """df with <name>_n, the number of versions that match, and the fields to take of an only one as <name>_<field>.

    Rows stay as they are and meet the version of a key that has one; only rows of other keys are counted by
    locator. No key of a row is null.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"v.{k}") for k in keys], match)
    several, n = _several(versions, keys)
    if not n:
        return _met(df, versions, on, keys, take, name)
    df, several = settled(df), _few(several, n)
    split = lambda how: (df.join(several, keys, how), versions.join(several, keys, how))
    return _met(*split("left_anti"), on, keys, take, name).unionByName(_counted(*split("left_semi"), on, keys, take, name))


def _met(df: DataFrame, versions: DataFrame, on: Column, keys: list[str], take: list[str], name: str) -> DataFrame:
    """_covering() where a key has one version at most."""
    taken = [F.col(f"v.{c}").alias(f"{name}_{c}") for c in take]
    return df.alias("l").join(versions.alias("v"), on, "left").select("l.*", F.col(f"v.{keys[0]}").isNotNull().cast("long").alias(f"{name}_n"), *taken)


def _counted(df: DataFrame, versions: DataFrame, on: Column, keys: list[str], take: list[str], name: str) -> DataFrame:
    """_covering() whatever number of versions a key has."""
    left = df.select("locator", *dict.fromkeys([*keys, *[c for c in df.columns if c in ("interval_start_utc", "interval_end_utc", "reading_at_utc")]])).alias("l")
    found = left.join(versions.alias("v"), on).groupBy("l.locator").agg(F.count("*").alias(f"{name}_n"), *(F.max(f"v.{c}").alias(f"{name}_{c}") for c in take))
    return df.join(found, "locator", "left").withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(0).cast("long")))


def _single(n: str, missing: str, ambiguous: str) -> dict[str, Column]:
    return {missing: F.col(n) == 0, ambiguous: F.col(n) > 1}


def intervals(feeds: Feeds) -> Feeds:
    """Interval rows and readings against the versions in force; these are taken before any row is judged.

    A point's version takes the periods of its customer and site along where each of these has one version.
    """
    out = dict(feeds)
    rows = {f: current(feeds[f], f) for f in (*EFFECTIVE, "commitment_schedule")}
    customers, sites = rows["customer_master"].where("lifecycle_status = 'active'"), rows["industrial_site_master"].where("operational_status = 'operational'")
    meters = rows["revenue_meter_assignment"].where("assignment_role = 'authoritative_revenue'")
    inside = F.expr("v.effective_from_utc <= l.interval_start_utc and (v.effective_to_utc is null or l.interval_end_utc <= v.effective_to_utc)")
    points, along = rows["delivery_point_assignment"], {}
    owners = {"customer": (customers, "customer_natural_id"), "site": (sites, "site_natural_id")}
    for name, (versions, key) in owners.items():
        if not _several(versions, [key])[1]:
            along[name] = [f"{name}_there", f"{name}_from", f"{name}_to"]
            own = (F.lit(True), F.col("effective_from_utc"), F.col("effective_to_utc"))
            points = points.join(versions.select(key, *(c.alias(n) for c, n in zip(own, along[name]))), key, "left")
    points = settled(points.select("delivery_point_natural_id", "customer_natural_id", "site_natural_id", "effective_from_utc", "effective_to_utc", *sum(along.values(), [])), "points")
    for feed in INTERVALS:
        df = _covering(_valid(feeds[feed]), points, ["delivery_point_natural_id"], ["customer_natural_id", "site_natural_id", *sum(along.values(), [])], "point", inside)
        rules = _single("point_n", "delivery_point_assignment_coverage_missing", "delivery_point_assignment_coverage_ambiguous")
        one = F.col("point_n") == 1
        for name, (versions, key) in owners.items():
            if name in along:
                within = f"point_{name}_there and point_{name}_from <= interval_start_utc and (point_{name}_to is null or interval_end_utc <= point_{name}_to)"
                df = df.withColumn(f"{name}_n", F.coalesce(F.expr(within), F.lit(False)).cast("long"))
            else:
                df = settled(df)
                asked = _covering(df.where(one), versions.withColumnRenamed(key, f"point_{key}"), [f"point_{key}"], [], name, inside)
                df = asked.unionByName(df.where(~one).withColumn(f"{name}_n", F.lit(0).cast("long")))
            rules |= {code: one & rule for code, rule in _single(f"{name}_n", f"{name}_effective_coverage_missing", f"{name}_effective_coverage_ambiguous").items()}
        if feed != "delivery_point_capacity_assessment":
            df = _covering(df, rows["contract_terms"], ["contract_natural_id"], ["delivery_point_natural_id", "customer_natural_id"], "terms", inside)
            rules["assignment_customer_mismatch"] = one & (F.col("customer_natural_id") != F.col("point_customer_natural_id"))
            rules |= {code: one & rule for code, rule in _single("terms_n", "contract_effective_coverage_missing", "contract_effective_coverage_ambiguous").items()}
            for code, key in (("contract_delivery_point_mismatch", "delivery_point_natural_id"), ("contract_customer_mismatch", "customer_natural_id")):
                rules[code] = one & (F.col("terms_n") == 1) & (F.col(key) != F.col(f"terms_{key}"))
        if feed == "approved_excess_order":
            df = _covering(df, rows["commitment_schedule"], ["delivery_point_natural_id", "interval_start_utc"], ["obligation_status", "committed_mwh_th"], "base", F.lit(True))
            positive = F.coalesce((F.col("base_obligation_status") == "committed") & (F.col("base_committed_mwh_th") > 0), F.lit(False))
            rules |= {"positive_commitment_missing": (F.col("base_n") == 0) | (F.col("base_n") == 1) & ~positive, "commitment_current_version_ambiguous": F.col("base_n") > 1}
        out[feed] = _marked(feeds[feed], df, rules)
    held = F.expr("v.effective_from_utc <= l.reading_at_utc and (v.effective_to_utc is null or l.reading_at_utc < v.effective_to_utc)")
    df = _covering(_valid(feeds["revenue_meter_reading"]), meters, ["meter_natural_id", "register_natural_id"], ["register_type", "native_unit"], "meter", held)
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"meter_{c}"))
    rules = _single("meter_n", "meter_assignment_coverage_missing", "meter_assignment_coverage_ambiguous") | {"meter_register_metadata_mismatch": (F.col("meter_n") == 1) & (differs("register_type") | differs("native_unit"))}
    out["revenue_meter_reading"] = _marked(feeds["revenue_meter_reading"], df, rules)
    return out


def _marked(df: DataFrame, judged: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with the issues of its valid rows, which are judged; the others stay."""
    return issued(judged, _when(rules)).select(*df.columns).unionByName(df.where(f"not ({VALID})"))


def cells(df: DataFrame, feed: str) -> DataFrame:
    """What the passes read of a feed's rows."""
    contract = CONTRACTS[feed]
    read = {*JUDGED, *READ, *contract.episode, "source_revision", contract.opaque}
    return df.select("locator", "identity", "payload_sha256", "issues", "replay", "unread", *(f.name for f in contract.fields if f.name in read))


def _read(lines: Feeds, feed: str) -> DataFrame:
    if unknown := set(lines) - set(CONTRACTS):
        raise ValueError(f"unsupported_dataset: {', '.join(sorted(unknown))}")
    return parsed(lines.get(feed, next(iter(lines.values())).limit(0)), feed, CONTRACTS[feed])


def judged(rows: Feeds) -> Feeds:
    """locator, issues, replay, accepted_locator and outcome of each feed's cells, of which each feed has one frame."""
    feeds: Feeds = {}
    for feed, df in rows.items():
        contract = CONTRACTS[feed]
        df = unduplicated(df)
        df = local(opaque_once(df, contract.opaque) if contract.opaque else df, feed)
        if feed in (*EFFECTIVE, "commitment_schedule"):
            df = newest(df, list(contract.episode))
        spent = {"identity", "payload_sha256", "unread", *READ, "source_revision", contract.opaque} - {"effective_to_utc"}
        feeds[feed] = settled(df.drop(*(c for c in spent if c in df.columns)), feed)
    feeds = intervals(references(overlaps(references(feeds))))
    outcome = F.when(F.size("issues") > 0, "quarantined").when(F.col("replay"), "replay").otherwise("accepted")
    return {feed: df.select("locator", "issues", "replay", "accepted_locator", outcome.alias("outcome")) for feed, df in feeds.items()}


def outcomes(lines: Feeds) -> Feeds:
    """What validate() says of each line, without the line's row: locator, issues, replay, accepted_locator and outcome."""
    return judged({feed: settled(cells(_read(lines, feed), feed), feed) for feed in CONTRACTS})


def validate(lines: Feeds) -> Feeds:
    """Each feed's rows (typed, with locator, line, identity, payload_sha256, failures, issues) and their outcome.

    lines: by feed, rows of locator (unique within the feed, in the order of lines) and line. Feeds
    that aren't given count as empty here; read_bundle tells of them. An unknown feed raises, and so does
    a bundle without any feed.
    """
    rows = {feed: settled(_read(lines, feed), feed) for feed in CONTRACTS}
    said = judged({feed: cells(df, feed) for feed, df in rows.items()})
    return {feed: settled(df.drop("issues", "replay").join(said[feed], "locator"), feed) for feed, df in rows.items()}


def report(feeds: Feeds, bundle: DataFrame | None = None) -> DataFrame:
    """feed, outcome, code (null but for quarantined rows) and rows; a row counts under each of its codes.

    Issues of the bundle (feed, code) have the outcome bundle and no rows.
    """
    each = [df.select(F.lit(feed).alias("feed"), "outcome", F.explode_outer("issues").alias("code")) for feed, df in feeds.items()]
    counts = reduce(DataFrame.unionByName, each).groupBy("feed", "outcome", "code").agg(F.count("*").alias("rows"))
    return counts if bundle is None else counts.unionByName(bundle.select("feed", F.lit("bundle").alias("outcome"), "code", F.lit(0).cast("bigint").alias("rows")))


def accepted(feeds: Feeds) -> Feeds:
    """Accepted rows in the form that the mart takes, with the hashes of identity and payload."""
    own = lambda feed: [f.name for f in CONTRACTS[feed].fields]
    return {feed: df.where("outcome = 'accepted'").select(*own(feed), F.sha2("identity", 256).alias("pipeline_identity_sha256"), F.col("payload_sha256").alias("pipeline_payload_sha256")) for feed, df in feeds.items()}


def write_outcomes(feeds: Feeds, folder: str, bundle: DataFrame | None = None) -> None:
    """accepted/<feed> as Parquet; lines/<feed>, accepted objects in their canonical form, of which the payload's hash
    is; quarantined/<feed> as JSON lines with issues, the line, its locator and number; replays/<feed> likewise with
    the locator of the accepted line; report; and last files: path, bytes and sha256 of each.

    A folder without files isn't published yet: readers go by that table, and a run that broke is written anew.
    """
    spark = next(iter(feeds.values())).sparkSession
    for feed, df in accepted(feeds).items():
        df.write.mode("overwrite").parquet(f"{folder}/accepted/{feed}")
    for feed, df in feeds.items():
        number = ["line_number"] if "line_number" in df.columns else []
        objects(df.where("outcome = 'accepted'").select("line")).select("payload").write.mode("overwrite").text(f"{folder}/lines/{feed}")
        df.where("outcome = 'replay'").select("locator", *number, "identity", "payload_sha256", "accepted_locator").write.mode("overwrite").json(f"{folder}/replays/{feed}")
        df.where("outcome = 'quarantined'").select("locator", *number, "identity", "payload_sha256", F.array_sort("issues").alias("issues"), "failures", "line").write.mode("overwrite").json(f"{folder}/quarantined/{feed}")
    report(feeds, bundle).write.mode("overwrite").parquet(f"{folder}/report")
    hashed([f"{folder}/{part}" for part in PUBLISHED], spark).write.mode("overwrite").parquet(f"{folder}/files")


def hashed(folders: list[str], spark: SparkSession) -> DataFrame:
    """path, bytes and sha256 of every file below the folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def altered(spark: SparkSession, folder: str) -> DataFrame:
    """path of each published file that is gone or no longer has its hash, and of each file that was added."""
    now = hashed([f"{folder}/{part}" for part in PUBLISHED], spark).select("path", F.col("sha256").alias("_now"))
    return spark.read.parquet(f"{folder}/files").join(now, "path", "full").where("not (sha256 <=> _now)").select("path")
