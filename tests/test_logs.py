"""Logs in ranges of bytes, and printed dicts, against Python's own splitlines and literal_eval."""

import ast
import math
import random

import pytest
from pyspark.sql import functions as F

from loamline.functions import json_values as js
from loamline.operators import log_replay


@pytest.mark.parametrize("size", ["64m", "100b"])
def test_read_log_numbers_lines_as_splitlines(spark, tmp_path, size):
    rng = random.Random(3)
    texts = {}
    for name in ("a", "b", "c.d"):
        texts[name] = "".join(rng.choice(["x", "é", "line ", "😀", "\n", "\r\n", "\r", "\x0b", "\x85", " "]) for _ in range(2500)) + rng.choice(["end", "end\n", "\n\r\n"])
        (tmp_path / f"{name}.log").write_bytes(texts[name].encode())
    (tmp_path / "empty.log").write_text("")
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = log_replay.read_log(spark, str(tmp_path)).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(r.run, []).append((r.ord, r.line))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: t.splitlines() for k, t in texts.items()}
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in got.values())


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind == 6:
        return tuple(value(rng, depth + 1) for _ in range(rng.randrange(3)))
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 8:
        return {rng.choice("abc"): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return rng.choice([1, -2.5, 1e-20, 10**20, None, True, "te'xt", 'a"b\\n', "3.5", "{'x': 1}", "nan, inf"])


def number(x):
    if isinstance(x, (bool, list, tuple, dict)) or x is None:
        return None
    try:
        return float(x)
    except ValueError:
        return None


def test_printed_dicts(spark):
    rng = random.Random(4)
    dicts = [{rng.choice(["loss", "eval_loss"]): value(rng), **{rng.choice("xyz"): value(rng) for _ in range(rng.randrange(4))}} for _ in range(500)]
    lines = [f"  {d}\n" for d in dicts]
    got = [r.x for r in spark.createDataFrame([(t,) for t in lines], "t string").select(js.python_dict(F.col("t")).alias("x")).collect()]
    assert got == [{k: number(v) for k, v in ast.literal_eval(t.strip()).items()} for t in lines]


def test_numbers_without_literals_and_no_dicts(spark):
    lines = ["{'loss': nan, 'a': -inf, 'b': 'inf nan', 'c': inf}", "{'loss': 1.5, 'a': (1, 2)}", "{'loss': broken", "{'other': 1}", "{'loss': 1} x", None, "", "{'loss'}", "{'loss': __import__('os')}"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in lines], "t string").select(js.python_dict(F.col("t")).alias("x")).collect()]
    assert math.isnan(got[0]["loss"]) and (got[0]["a"], got[0]["b"], got[0]["c"]) == (-math.inf, None, math.inf)
    assert got[1:] == [{"loss": 1.5, "a": None}] + [None] * 7
