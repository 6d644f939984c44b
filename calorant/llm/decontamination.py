"""Benchmark decontamination by template windows, in DataFrame functions alone.

Texts become templates: words are lower-cased and freed of marks, and numbers, units after a number
and names become typed placeholders. There are two forms: the plain one has a placeholder a word and
none at sentence starts, the whole one has a placeholder for a whole number and for a whole run of
capitalised words wherever it stands. Windows of a template are joined by hash with the benchmark's.
Matches of one item along one diagonal are one occurrence; it counts if enough windows match and its
slots are consistent: wherever the item repeats a value, the document repeats the value that it has in
its place. So a question with other numbers, names or units is caught, while text that only shares a
form with it isn't.

Any window holds one of every STRIDE-th SEED words of its text, so a text none of whose seeds is one
of the benchmark's has no match. Windows are made of the texts that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint

WINDOW = 8
#: Least words of a window that are no placeholder, and least matching windows of an occurrence.
LITERAL = 5
MATCHES = 3
#: The same for items all of whose windows have fewer: these must match in all such windows.
LOOSE = 2
#: The benchmark's windows, and the matched texts' keys, are broadcast up to this many rows (of about 40 bytes); beyond, both sides are shuffled.
BROADCAST = 500_000

#: Unit words, matched after a number.
UNITS = (
    "mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|hz|khz|mhz|ghz|w|kw|mw|kwh|mwh|j|kj|v|a|k|c|f|b|kb|mb|gb|tb|usd|eur|gbp|pct|percent|"
    "meter|meters|metre|metres|kilometer|kilometers|mile|miles|foot|feet|inch|inches|gram|grams|kilogram|kilograms|pound|pounds|ounce|ounces|liter|liters|litre|litres|"
    "second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|degree|degrees|dollar|dollars|euro|euros|cent|cents|watt|watts|volt|volts"
)
NAME_RULE = r"([\p{Ll}\p{N},;:] )\p{Lu}\p{L}+"
#: A token of the whole form: a run of capitalised words, a number with separators and decimals, or a word. {once} is + where
#: groups can be possessive, which keeps long runs off Java's stack, and empty elsewhere.
NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
WHOLE = NAME + r"(?:(?:[ \t\r\n]+|-)" + NAME + r")*{once}|[0-9]+(?:[.,][0-9]+)*{once}|\p{L}+\p{N}*|\p{N}+"
NAMED = r"^\p{Lu}['’\p{L}]"


def _normal(text: Column) -> Column:
    """Words in lower case with two spaces between and one around, digits parted from letters after them."""
    parted = F.regexp_replace(text, r"([0-9])(\p{L})", "$1 $2")
    words = F.lower(F.trim(F.regexp_replace(parted, r"[^\p{L}\p{N}]+", " ")))
    return F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))


def words(text: Column) -> Column:
    return F.split(F.trim(_normal(text)), "  ")


def template(text: Column) -> Column:
    """Words of a text with zznum, zzunit and zzname for numbers, units after them and names; as many as words()."""
    named = _normal(F.regexp_replace(text, NAME_RULE, "$1zzname"))
    numbered = F.regexp_replace(named, " [0-9]+ ", " zznum ")
    return F.split(F.trim(F.regexp_replace(numbered, f" zznum  ({UNITS}) ", " zznum  zzunit ")), "  ")


def whole_words(text: Column) -> Column:
    """Words of a text in lower case, with a whole number and a whole run of capitalised words as one each."""
    return F.transform(F.regexp_extract_all(text, F.lit(WHOLE.replace("{once}", "+")), F.lit(0)), lambda v: F.lower(v))


def whole_template(text: Column) -> Column:
    """whole_words() with placeholders: one for a whole number, and one for a whole run of capitalised words wherever it stands."""
    units = UNITS.split("|")
    digit = lambda v: F.substring(v, 1, 1).between("0", "9")
    form = lambda t, v, k: F.when(digit(v), "zznum").when(v.rlike(NAMED), "zzname").when(F.lower(v).isin(units) & (k > 0) & digit(F.get(t, k - 1)), "zzunit").otherwise(F.lower(v))
    found = F.regexp_extract_all(text, F.lit(WHOLE.replace("{once}", "+")), F.lit(0))
    return F.transform(F.array(found), lambda t: F.transform(t, lambda v, k: form(t, v, k)))[0]


def hashed_windows(df: DataFrame, window: int, template=template) -> DataFrame:
    """df (with text, not null) with position (from 1) and hash of each window of its template, in place of its text."""
    own = [c for c in df.columns if c != "text"]
    # bound to a lambda's variable, so that the words are made once a text and not once a window
    hashed = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    slide = lambda h: F.when(F.size(h) >= window, F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
    arrays = df.select(*own, F.transform(F.array(template(F.col("text"))), lambda t: F.transform(F.array(hashed(t)), slide)[0])[0].alias("windows"))
    return arrays.select(*own, F.posexplode("windows").alias("position", "hash")).withColumn("position", F.col("position") + 1)


FORMS = ((template, words), (whole_template, whole_words))
HOLES = ("zznum", "zzunit", "zzname")
ROW = ["row", "check"]


def _seeded(window: int) -> tuple[int, int]:
    """Words of a seed and places between two, so that every window holds one."""
    return window // 2 + 1, window - window // 2


def _keys(items: DataFrame, window: int, literal: int, matches: int, form: int) -> DataFrame:
    """The windows of items to look for: item_id, item_position, hash, needed (matching windows of an occurrence) and seeds."""
    tokens = items.select("item_id", FORMS[form][0](F.col("text")).alias("f")).where(F.size("f") >= window)
    each = tokens.select("item_id", "f", F.transform("f", lambda t: F.xxhash64(t)).alias("h"), F.explode(F.sequence(F.lit(1), F.size("f") - (window - 1))).alias("item_position"))
    size, stride = _seeded(window)
    seeds = F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda k: F.xxhash64(F.slice("f", F.col("item_position") + k, size), F.lit(form)))
    holes = F.size(F.filter(F.slice("f", F.col("item_position"), window), lambda t: t.isin(*HOLES)))
    each = each.select("item_id", "item_position", F.xxhash64(F.slice("h", F.col("item_position"), window)).alias("hash"), seeds.alias("seeds"), holes.alias("holes"))
    strict = each.groupBy("item_id").agg(F.sum((F.col("holes") <= window - literal).cast("int")).alias("strict"))
    kept = each.join(strict, "item_id").where(F.col("holes") <= F.when(F.col("strict") > 0, window - literal).otherwise(window - LOOSE))
    needed = kept.groupBy("item_id").agg(F.when(F.max("strict") > 0, F.least(F.count("*"), F.lit(matches))).otherwise(F.count("*")).alias("needed"))
    return kept.join(needed, "item_id").select("item_id", "item_position", "hash", "needed", "seeds")


def _seeds(text: Column, window: int, form: int) -> Column:
    size, stride = _seeded(window)
    slide = lambda t: F.when(F.size(t) >= size, F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1), F.lit(stride)), lambda i: F.xxhash64(F.slice(t, i, size), F.lit(form)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(FORMS[form][0](text)), slide)[0]


def _some(df: DataFrame) -> DataFrame:
    """df to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row": F.xxhash64("doc_id", "text"), "check": F.xxhash64("text", "doc_id")})


def _held(docs: DataFrame, items: DataFrame, keys: DataFrame, window: int, form: int) -> DataFrame:
    """Rows (ROW) and the items that they hold by one form: windows and slots of each occurrence."""
    template, words = FORMS[form]
    token = items.select("item_id", F.posexplode(F.arrays_zip(template(F.col("text")).alias("form"), words(F.col("text")).alias("value"))).alias("at", "t")).select("item_id", (F.col("at") + 1).alias("at"), "t.form", "t.value")
    slots = token.where(F.col("form").isin(*HOLES))
    hits = hashed_windows(docs.select(*ROW, "text"), window, template).join(_some(keys.drop("seeds")), "hash").select(*ROW, "item_id", "item_position", "needed", (F.col("position") - F.col("item_position")).alias("diagonal"))
    runs = checkpoint(
        hits.groupBy(*ROW, "item_id", "diagonal").agg(F.countDistinct("item_position").alias("windows"), F.collect_set("item_position").alias("positions"), F.max("needed").alias("needed"))
        .where("windows >= needed").drop("needed")
    )
    # the slots of each occurrence: an item's value and what stands in its place in the document
    covered = runs.join(slots, "item_id").where(F.exists("positions", lambda p: (F.col("at") >= p) & (F.col("at") < p + window)))
    texts = docs.join(_some(runs.select(*ROW).distinct()), ROW, "left_semi").select(*ROW, words(F.col("text")).alias("words"))
    values = covered.join(texts, ROW).select(*ROW, "item_id", "diagonal", "value", F.col("words")[F.col("at") + F.col("diagonal") - 1].alias("other"))
    checked = values.groupBy(*ROW, "item_id", "diagonal", "value").agg((F.min("other") == F.max("other")).alias("same"), F.count("*").alias("n")).groupBy(*ROW, "item_id", "diagonal").agg(F.min("same").alias("same"), F.sum("n").alias("slots"))
    held = runs.join(checked, [*ROW, "item_id", "diagonal"], "left").where("same is null or same")
    return held.select(*ROW, "item_id", "windows", F.coalesce("slots", F.lit(0)).alias("slots"))


def _whole(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """Rows (ROW) that are an item too short for windows, by all their words; None if there is no such item."""
    short = items.select("item_id", words(F.col("text")).alias("own")).where((F.size("own") < window) & (F.size(whole_words(F.col("text"))) < window) & (F.array_join("own", "") != ""))
    short = checkpoint(short.select("item_id", F.array_join("own", " ").alias("own")))
    if short.isEmpty():
        return None
    found = docs.select(*ROW, F.array_join(words(F.col("text")), " ").alias("own")).join(_some(short), "own")
    return found.select(*ROW, "item_id", F.lit(0).cast("bigint").alias("windows"), F.lit(0).cast("bigint").alias("slots"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, matches: int = MATCHES) -> DataFrame:
    """Each row of docs that holds an item, by ROW, with doc_id, item_id, windows and slots of its best occurrence by either form."""
    docs = _keyed(docs.where("text is not null").select("doc_id", "text"))
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    keys = [checkpoint(_keys(items, window, literal, matches, form)) for form in range(len(FORMS))]
    known = keys[0].select("seeds").union(keys[1].select("seeds")).select(F.explode("seeds").alias("seed")).distinct()
    seeds = docs.select(*ROW, F.explode(F.flatten(F.array(*(_seeds(F.col("text"), window, form) for form in range(len(FORMS)))))).alias("seed"))
    near = checkpoint(seeds.join(_some(known), "seed", "left_semi").select(*ROW).distinct())
    likely = checkpoint(docs.join(_some(near), ROW, "left_semi").distinct())
    held = _held(likely, items, keys[0], window, 0).unionByName(_held(likely, items, keys[1], window, 1))
    if (same := _whole(docs, items, window)) is not None:
        held, likely = held.unionByName(same), likely.unionByName(docs.join(_some(same.select(*ROW).distinct()), ROW, "left_semi").distinct()).distinct()
    best = held.groupBy(*ROW, "item_id").agg(F.max(F.struct("windows", "slots")).alias("b"))
    return likely.select(*ROW, "doc_id").join(best, ROW).select(*ROW, "doc_id", "item_id", "b.windows", "b.slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, matches: int = MATCHES) -> DataFrame:
    """Pairs of document and item that it holds: doc_id, item_id, windows (that match) and slots (placeholders checked).

    A row for each pair, with the occurrence of most windows by either form. A document without
    matches gives no row, nor does a null or empty text; rows with a null doc_id give pairs with
    null. An item shorter than the window by both forms is found in texts of just its words (windows 0);
    one without two words besides its placeholders in any window is never found. An item with fewer windows than `matches` must match in
    all, and so must one all of whose windows have fewer than `literal` words besides placeholders.
    Rows of one doc_id give one row per item. A text of any length is matched whole; its words are
    one row's array. Empty tables give none; other columns are ignored.
    """
    found = occurrences(docs, benchmark, window, literal, matches)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", "slots")).alias("b")).select("doc_id", "item_id", "b.windows", "b.slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns.

    A row is judged by its own text: rows without an id, and rows that share one, stay or go apart.
    Null and empty texts stay.
    """
    row, check = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")
    fresh = "_".join(docs.columns)  # longer than any column's name
    held = occurrences(docs, benchmark).select(F.col("row").alias(f"{fresh}_row"), F.col("check").alias(f"{fresh}_check")).distinct()
    return docs.join(_some(held), (row == F.col(f"{fresh}_row")) & (check == F.col(f"{fresh}_check")), "left_anti")


def _sql_template(text: str) -> tuple[str, str]:
    normal = lambda x: f"' ' || replace(lower(trim(regexp_replace(regexp_replace({x}, '([0-9])(\\p{{L}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ', '  ') || ' '"
    named = normal(f"regexp_replace({text}, '{NAME_RULE}', '\\1zzname', 'g')")
    form = f"regexp_replace(regexp_replace({named}, ' [0-9]+ ', ' zznum ', 'g'), ' zznum  ({UNITS}) ', ' zznum  zzunit ', 'g')"
    return f"string_split(trim({form}), '  ')", f"string_split(trim({normal(text)}), '  ')"


def _sql_whole(text: str) -> tuple[str, str]:
    pattern, named = WHOLE.replace("{once}", "").replace("'", "''"), NAMED.replace("'", "''")
    units = ", ".join(f"'{u}'" for u in UNITS.split("|"))
    found = f"regexp_extract_all({text}, '{pattern}')"
    digit = lambda v: f"{v}[1] BETWEEN '0' AND '9'"
    form = f"list_transform({found}, lambda v, k: CASE WHEN {digit('v')} THEN 'zznum' WHEN regexp_matches(v, '{named}') THEN 'zzname' WHEN lower(v) IN ({units}) AND k > 1 AND {digit(f'({found})[k - 1]')} THEN 'zzunit' ELSE lower(v) END)"
    return form, f"list_transform({found}, lambda v: lower(v))"


def oracle() -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM ({_oracle(form)})" for form in (_sql_template, _sql_whole)) + f" UNION ALL SELECT * FROM ({_short_oracle()})"
    return f"SELECT doc_id, item_id, m.w AS windows, m.s AS slots FROM (SELECT doc_id, item_id, max({{'w': windows, 's': slots}}) AS m FROM ({rows}) GROUP BY ALL)"


def _short_oracle(window: int = WINDOW) -> str:
    own, whole = _sql_template("text")[1], _sql_whole("text")[1]
    return f"""
SELECT doc_id, item_id, 0::BIGINT AS windows, 0::BIGINT AS slots FROM (SELECT doc_id, {own} AS v FROM documents WHERE text IS NOT NULL) d
JOIN (SELECT DISTINCT item_id, {own} AS v, {whole} AS u FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) b ON d.v = b.v WHERE len(b.v) < {window} AND len(u) < {window} AND b.v <> ['']"""


def _oracle(sql, window: int = WINDOW, literal: int = LITERAL, matches: int = MATCHES) -> str:
    form, value = sql("text")
    hole = "('zznum', 'zzunit', 'zzname')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {form} AS f, {value} AS v FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, {form} AS f, {value} AS v FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, p, list_slice(f, p, p + {window - 1}) AS w FROM b, unnest(range(1, len(f) - {window - 2})) AS s(p)),
said_words AS (SELECT *, len(list_filter(w, lambda x: x NOT IN {hole})) AS words FROM bw),
most AS (SELECT item_id, max(words) AS most FROM said_words GROUP BY 1),
k AS (SELECT item_id, p, w, most >= {literal} AS strict FROM said_words JOIN most USING (item_id) WHERE words >= CASE WHEN most >= {literal} THEN {literal} ELSE {LOOSE} END),
need AS (SELECT item_id, CASE WHEN bool_or(strict) THEN least(count(*), {matches}) ELSE count(*) END AS needed FROM k GROUP BY 1),
dw AS (SELECT r, p, list_slice(f, p, p + {window - 1}) AS w FROM d, unnest(range(1, len(f) - {window - 2})) AS s(p)),
hit AS (SELECT DISTINCT r, item_id, dw.p - k.p AS diagonal, k.p AS q FROM dw JOIN k USING (w)),
run AS (SELECT r, item_id, diagonal, count(*) AS windows FROM hit GROUP BY ALL),
good AS (SELECT run.* FROM run JOIN need USING (item_id) WHERE windows >= needed),
spot AS (SELECT DISTINCT r, item_id, diagonal, place FROM hit JOIN good USING (r, item_id, diagonal), unnest(range(q, q + {window})) AS s(place)),
pair AS (SELECT spot.r, spot.item_id, diagonal, b.v[place] AS value, d.v[place + diagonal] AS other FROM spot JOIN b USING (item_id) JOIN d ON d.r = spot.r WHERE b.f[place] IN {hole}),
slot AS (SELECT r, item_id, diagonal, value, count(DISTINCT other) AS others, count(*) AS n FROM pair GROUP BY ALL),
said AS (SELECT r, item_id, diagonal, max(others) AS others, sum(n) AS slots FROM slot GROUP BY ALL),
best AS (SELECT r, item_id, max({{'w': windows, 's': coalesce(slots, 0)}}) AS m FROM good LEFT JOIN said USING (r, item_id, diagonal) WHERE others IS NULL OR others = 1 GROUP BY ALL),
top AS (SELECT doc_id, item_id, max(m) AS m FROM best JOIN d USING (r) GROUP BY ALL)
SELECT doc_id, item_id, m.w::BIGINT AS windows, m.s::BIGINT AS slots FROM top
"""
