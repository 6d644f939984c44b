"""JSON lines: numbered however files are split, and read once into the tokens of an object.

The canonical form of an object is JSON with its keys in code-point order at every depth, no spaces,
no escapes that aren't needed, integers digit by digit, and other numbers as the shortest decimal of
their double. A token is a value in that form.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorant.plans.folders import settled

#: Splits of files are broadcast up to this many; beyond, lines are dealt out by split.
BROADCAST = 200_000
SPACE = r"[\x20\t\r\n]"
TEXT = r'"[^"\\\x00-\x1F]*+"'
#: Integers of a long; decimals of up to 15 digits that a double prints without an exponent.
WHOLE = r"(?:0|-?[1-9][0-9]{0,17}+)"
DECIMAL = r"(?!-?0\.0000[0-9]*[1-9])-?(?:0|[1-9][0-9]{0,8}+)\.[0-9]{1,6}+"
ENTRY = rf'"([^"\\\x00-\x1F]*+)"{SPACE}*+:{SPACE}*+({TEXT}|{DECIMAL}|{WHOLE}|true|false|null)'
#: Marks that no JSON text holds.
EDGE, PAIR = "\x01", "\x02"
#: Orders of keys that a task remembers.
SHAPES = 1_000


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_number (from 1) and line of text files.

    A line's number is the count of lines of its file's earlier splits, and its own in its split. Splits
    are counted first, without their text; a file may have any number of them, and a task several.
    """
    read = spark.read.text(path)
    meta = F.col("_metadata")
    rows = read.select(meta.file_path.alias("path"), meta.file_name.alias("file"), meta.file_block_start.alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = settled(splits.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), "splits")
    few = offsets.limit(BROADCAST + 1).count() <= BROADCAST
    placed = rows.join(F.broadcast(offsets) if few else offsets, ["path", "split"])
    return placed.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), "line")


class _Repeated(Exception):
    pass


def _once(pairs: list[tuple]) -> dict:
    value = dict(pairs)
    if len(value) < len(pairs):
        raise _Repeated
    return value


def _refused(name: str):
    raise ValueError(name)


def _carried(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates as escapes."""
    return text.encode("utf-8", "backslashreplace").decode()


def _canonical(value, finite: bool = True) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=not finite)


_DECODER = json.JSONDecoder(parse_constant=_refused, object_pairs_hook=_once)


def _loaded(line: str) -> tuple[str | None, dict | None]:
    """issue and object of a line."""
    text = line.rstrip("\r\n")
    if not text.strip():
        return "empty_jsonl_line", None
    try:
        value = _DECODER.decode(text)
    except _Repeated:
        return "duplicate_json_key", None
    except (ValueError, RecursionError):
        return "invalid_json", None
    return (None, value) if isinstance(value, dict) else ("record_not_object", None)


def read_object(line: str) -> tuple:
    """issue, payload, keys and tokens of a line; the payload is null where it has no canonical form."""
    issue, value = _loaded(line)
    return (issue, None, None, None) if issue else _told(value)


def _told(value: dict) -> tuple:
    try:
        payload = _canonical(value)
        payload.encode()
    except (ValueError, RecursionError):
        payload = None
    return None, payload, [_carried(k) for k in value], [_carried(encode_basestring(v) if type(v) is str else _canonical(v, False)) for v in value.values()]


def _reader():
    """read_object() of batches of lines, as a function of columns."""

    def run(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in lines:
            rows = [(None,) * 4 if line is None else read_object(line) for line in batch]
            yield pd.DataFrame(rows, columns=["issue", "payload", "keys", "tokens"], dtype=object)

    run.__annotations__ = {"lines": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "issue string, payload string, keys array<string>, tokens array<string>")


def objects(df: DataFrame, line: str = "line") -> DataFrame:
    """df with issue, payload (canonical text) and values (map of keys to tokens) of its lines.

    issue: empty_jsonl_line, duplicate_json_key (at any depth), invalid_json or record_not_object, else
    null. A null line is an empty one. An object with a number beyond a double, or with half of a
    surrogate pair, has values but no payload. Flat objects without escapes and with plain numbers, as
    feeds have, are read by one pattern; all other lines by a parser, to the same form.
    """
    own = F.coalesce(line, F.lit(""))
    marked = F.regexp_replace(own, ENTRY, f"{EDGE}$1{PAIR}$2{EDGE}")
    df = df.withColumn("_marked", F.when(~F.contains(own, F.lit(EDGE)) & ~F.contains(own, F.lit(PAIR)), marked))
    short = F.when(F.contains("_marked", F.lit(f"0{EDGE}")), F.regexp_replace("_marked", rf"(\.[0-9]+?)0++(?={EDGE})", "$1")).otherwise(F.col("_marked"))
    df = df.withColumn("_cut", F.split(short, EDGE))
    df = df.withColumn("_parts", F.sort_array(F.filter("_cut", lambda x, k: k % 2 == 1)))
    between = F.translate(F.array_join(F.filter("_cut", lambda x, k: k % 2 == 0), EDGE), " \t\r\n", "")
    n = F.size("_parts")
    expected = F.when(n == 0, "{}").otherwise(F.concat(F.lit("{"), F.repeat(F.lit(f"{EDGE},"), n - 1), F.lit(EDGE + "}")))
    df = df.withColumn("_plain", F.coalesce(between == expected, F.lit(False))).withColumn("_joined", F.array_join("_parts", EDGE))
    side = lambda k: F.transform("_parts", lambda x: F.substring_index(x, PAIR, k))
    df = df.withColumn("_keys", F.when(F.col("_plain"), side(1))).withColumn("_read", _reader()(F.when(~F.col("_plain"), own)))
    twice = F.size(F.array_distinct("_keys")) < F.size("_keys")
    df = df.withColumn("issue", F.when(F.col("_plain"), F.when(twice, "duplicate_json_key")).otherwise(F.col("_read.issue")))
    text = F.when(F.size("_parts") == 0, "{}").otherwise(F.concat(F.lit('{"'), F.replace(F.replace("_joined", F.lit(EDGE), F.lit(',"')), F.lit(PAIR), F.lit('":')), F.lit("}")))
    values = F.when(F.col("_plain"), F.map_from_arrays("_keys", side(-1))).otherwise(F.map_from_arrays("_read.keys", "_read.tokens"))
    sound = F.col("issue").isNull()
    return df.withColumn("payload", F.when(sound, F.when(F.col("_plain"), text).otherwise(F.col("_read.payload")))).withColumn("values", F.when(sound, values)).drop("_marked", "_cut", "_parts", "_joined", "_plain", "_keys", "_read")


def _token(value) -> str:
    """The canonical form of a value; raises where it has none."""
    if type(value) is str:
        return encode_basestring(value)
    if value is None or value is True or value is False:
        return "null" if value is None else "true" if value else "false"
    if type(value) is int or type(value) is float and isfinite(value):
        return repr(value)
    return _canonical(value)


def field_reader(names: list[str]) -> Callable[[str], tuple]:
    """A function of a line: issue, payload_sha256, other keys than names (in order), and the token of each name.

    All as read_object() has them. Where keys stand in a payload is found once for each order of keys.
    """
    shapes: dict[tuple, tuple] = {}
    none = (None,) * len(names)

    def shaped(keys: tuple) -> tuple:
        if len(shapes) >= SHAPES:
            shapes.clear()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        place = {k: i for i, k in enumerate(keys)}
        known = set(names)
        shapes[keys] = [(encode_basestring(keys[i]) + ":", i) for i in order], [place.get(n, len(keys)) for n in names], sorted(_carried(k) for k in keys if k not in known)
        return shapes[keys]

    def read(line: str) -> tuple:
        issue, value = _loaded(line)
        if issue:
            return issue, None, None, *none
        try:
            tokens = [encode_basestring(v) if type(v) is str else _token(v) for v in value.values()]
            parts, places, others = shapes.get(keys := tuple(value)) or shaped(keys)
            sha = hashlib.sha256(("{" + ",".join([k + tokens[i] for k, i in parts]) + "}").encode()).hexdigest()
            tokens.append(None)
            return None, sha, others, *[tokens[i] for i in places]
        except (ValueError, RecursionError):
            _, payload, keys, tokens = _told(value)
            own = dict(zip(map(_carried, value), tokens))
            sha = None if payload is None else hashlib.sha256(payload.encode()).hexdigest()
            return None, sha, sorted(k for k in own if k not in set(names)), *map(own.get, names)

    return read


def fields(df: DataFrame, names: list[str], line: str = "line") -> DataFrame:
    """df with issue, payload_sha256, others (keys that aren't names, in order) and _token_<name>, null where it is absent, of its lines.

    As objects() reads them, each line once; a null line is an empty one, and bytes that are no UTF-8 are U+FFFD.
    """
    kind = pa.struct([("issue", pa.string()), ("payload_sha256", pa.string()), ("others", pa.list_(pa.string())), *((f"_token_{n}", pa.string()) for n in names)])

    def run(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = field_reader(names)
        for batch in lines:
            columns = zip(*map(read, batch.to_pylist())) if len(batch) else [()] * kind.num_fields
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    run.__annotations__ = {"lines": Iterator[pa.Array], "return": Iterator[pa.Array]}
    returned = ", ".join(f"`{f.name}`: {'array<string>' if f.name == 'others' else 'string'}" for f in kind)
    read = F.arrow_udf(run, f"struct<{returned}>")
    df = df.withColumn("_read", read(F.make_valid_utf8(F.coalesce(line, F.lit("")))))
    return df.select(*(c for c in df.columns if c != "_read"), "_read.*")


def text_of(token: Column) -> Column:
    """The text that a token stands for; null if it is no text."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.startswith('"'), F.when(token.contains("\\"), F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]).otherwise(inner))


def is_number(token: Column) -> Column:
    return token.rlike("^(-?[0-9]|-?Infinity)")


def is_integral(token: Column) -> Column:
    """Integers, and other numbers without a fraction."""
    return token.rlike(r"^-?[0-9]+$") | is_number(token) & (token.try_cast("double") == F.floor(token.try_cast("double")).cast("double"))


