"""Lines against Python's own reader and writer of JSON, and line numbers against the files' lines."""

from __future__ import annotations

import hashlib
import json
import random

import pytest

from calorant.sources import jsonlines

LINES = [
    "", "  \t ", " ", "[1]", "1", "null", '"x"', "{", '{"a":}', '{"a":1,}', '{,"a":1}', '{"a":1 "b":2}', '{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":+1}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1} x', '{"a":"\t"}', "{'a':1}", '﻿{"a":1}', '{"a":tru}', '{"a":1e}',
    "{}", " { } ", '{"a":1,"a":2}', '{"b":{"a":1,"a":2}}', '{"a":[{"x":1,"x":1}]}', '{"a":{"b":{}}}', '{"z":1,"a":2,"é":3,"\U0001f600":4,"":5}', '{"a" : "x" ,\t"b":\r"y"}',
    *('{"a":' + n + "}" for n in "0 -0 -1 7 1.0 1.50 -0.0 0.0 100.000000 123456789.123456 0.0001 0.00010 0.00001 0.000010 -0.00004 12345678901234567 1234567890123456789012345 1e5 1E+2 1e16 1e22 1e23 5e-324 1e400 -1e400 0.1 0.30000000000000004 2.5e-7 123456789012345.678".split()),
    '{"a":"\\u0041\\n\\"\\\\\\/"}', '{"\\u0061":1,"b\\"c":2}', '{"a":"\\ud83d\\ude00"}', '{"a":"\\ud800"}', '{"a":"\x7f "}', '{"a":"","":"x"}', '{"a":"{\\"b\\":1}","c":"x:y,z"}', '{"a":true,"b":false,"c":null}', '{"a":"\\u0001"}', "[" * 3000 + "]" * 3000, '{"a":' + "[" * 90 + "]" * 90 + "}",
    '{"a":"x"\x01}', '{"a":"\x02"}', '{"a":1}\n', '{"\x7f":1}', '{"a":"' + "y" * 50_000 + '"}', json.dumps({f"k{i}": i for i in range(3000)}),
]


def expected(line):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError
        return dict(pairs)

    def refused(x):
        raise ValueError(x)

    text = line.rstrip("\r\n")
    if not text.strip():
        return "empty_jsonl_line", None
    try:
        value = json.loads(text, parse_constant=refused, object_pairs_hook=once)
    except KeyError:
        return "duplicate_json_key", None
    except (ValueError, RecursionError):
        return "invalid_json", None
    if not isinstance(value, dict):
        return "record_not_object", None
    try:
        return None, hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
    except ValueError:
        return None, None


def test_lines_equal_pythons_reader_and_writer(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, line string")
    got = {r.n: (r.issue, r.hash) for r in jsonlines.objects(df).selectExpr("n", "issue", "sha2(payload, 256) AS hash").collect()}
    wrong = [(line[:60], got[n], expected(line)) for n, line in enumerate(LINES) if got[n] != expected(line)]
    assert not wrong
    assert jsonlines.objects(spark.createDataFrame([(None,)], "line string")).first().issue == "empty_jsonl_line"


def test_random_objects_equal_pythons_writer(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 6)
        text = lambda: "".join(rng.choice('ab"\\\né\U0001f600 :,{}') for _ in range(rng.randint(0, 6)))
        if kind < 7:
            return [rng.randint(-(10**6), 10**6), rng.random() * 10 ** rng.randint(-8, 20), True, None, text(), round(rng.random(), 3), "plain"][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 7 else {text(): value(depth - 1) for _ in range(rng.randint(0, 4))}

    objects = [{f"k{rng.randint(0, 30)}{rng.choice(['', 'x', 'é'])}": value(2 if i % 2 else 0) for _ in range(rng.randint(0, 8))} for i in range(400)]
    lines = [json.dumps(o, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" , ", " :\t")])) for o in objects]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").repartition(2)
    got = {r.n: r.payload for r in jsonlines.objects(df).select("n", "payload").collect()}
    assert got == {n: json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for n, o in enumerate(objects)}


def test_tokens_keep_what_was_read(spark):
    line = '{"s":"a\\"b","p":"x","n":-3,"f":2.50,"i":2.0,"t":true,"z":null,"big":1e400,"o":{"b":1,"a":[]}}'
    for text in (line, line.replace(',"o":{"b":1,"a":[]}', "").replace('"a\\"b"', '"ab"').replace(',"big":1e400', "")):
        values = jsonlines.objects(spark.createDataFrame([(text,)], "line string")).first()["values"]
        assert (values["n"], values["f"], values["i"], values["t"], values["z"], values["p"]) == ("-3", "2.5", "2.0", "true", "null", '"x"')
    assert jsonlines.objects(spark.createDataFrame([(line,)], "line string")).first()["values"]["o"] == '{"a":[],"b":1}'


@pytest.mark.parametrize("size", ["40b", "1kb", "128mb"])
def test_lines_are_numbered_however_files_are_split(spark, tmp_path, size):
    rng = random.Random(len(size))
    want = []
    for name, n, gap in (("a.jsonl", 300, "\n"), ("b.jsonl", 1, ""), ("c.jsonl", 120, "\r\n"), ("d.jsonl", 0, "")):
        lines = [("x" * rng.randint(0, 30)) + str(i) if rng.random() < 0.9 or n == 1 else "" for i in range(n)]
        (tmp_path / name).write_bytes(gap.join(lines).encode() + (gap.encode() if lines and lines[-1] == "" else b""))
        want += [(name, i + 1, line) for i, line in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(tuple(r) for r in jsonlines.numbered(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want)
