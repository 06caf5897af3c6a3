"""Consensus, edits with shifts, trees and spectral clusters on small fixtures."""

import itertools
import json
import random

import numpy as np
import pytest

from sparkgauge.functions import overlap as O
from sparkgauge.functions.corpus import edit_distance
from sparkgauge.operators.spectral import nearest_edges, spectral


def test_shifted_edits():
    assert O.shifted_edits("a b c d".split(), "a b c d".split()) == 0
    assert O.shifted_edits("c d a b".split(), "a b c d".split()) == 1
    assert O.shifted_edits([], "a b".split()) == 2 and O.shifted_edits("a b".split(), []) == 2
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(6))] for _ in "ab")
        assert O.shifted_edits(a, b) <= edit_distance(a, b)


def mapped(a, b):
    """The least cost over all pairs of forests, by plain recursion on the last roots."""
    if not a and not b:
        return 0
    options = []
    if a:
        options.append(mapped(a[:-1] + tuple(a[-1][1]), b) + O._cost(a[-1][0], None))
    if b:
        options.append(mapped(a, b[:-1] + tuple(b[-1][1])) + O._cost(None, b[-1][0]))
    if a and b:
        options.append(mapped(tuple(a[-1][1]), tuple(b[-1][1])) + mapped(a[:-1], b[:-1]) + O._cost(a[-1][0], b[-1][0]))
    return min(options)


def test_tree_distance_equals_brute_force():
    values = [{}, {"a": "x"}, {"a": ["x", "yy"], "b": "z"}, {"menu": [{"n": "cake", "c": "2"}, {"n": "tea"}]}, {"a": {"b": {"c": "x"}}}, {"b": {"c": "xy"}}, ["q"]]
    for x, y in itertools.product(values, values):
        a, b = O.tree_of(x), O.tree_of(y)
        assert O.tree_distance(a, b) == mapped((a,), (b,)), (x, y)


def test_tree_accuracy(spark):
    rows = [(json.dumps({"a": "x"}), json.dumps({"a": "x"}), 1.0), ("no json", json.dumps({"a": "x"}), 0.0), (None, None, 1.0), (json.dumps({"a": "y" * 50}), "{}", 0.0)]
    df = spark.createDataFrame(rows, "p string, r string, want double")
    assert all(r.got == r.want for r in df.select("want", O.tree_accuracy("p", "r").alias("got")).collect())


def test_cider_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, None, "f g"), (3, "", None), (4, "x y", "y x")], "k long, p string, r string")
    got = {r.k: r.cider for r in O.cider(df, "k", "p", "r").collect()}
    assert got[1] == pytest.approx(10.0) and got[2] == got[3] == 0.0 and 0 < got[4] < 5
    assert O.cider(df.where("k < 0"), "k", "p", "r").count() == 0


def test_spoken(spark):
    df = spark.createDataFrame([("  <|en|>Hi ,  you ... there <|end|>",), (None,)], "t string")
    assert [r.x for r in df.select(O.spoken(df.t).alias("x")).collect()] == ["Hi, you... there ", None]


@pytest.mark.parametrize("normalised", [False, True])
def test_spectral_finds_blocks(spark, normalised):
    rng = np.random.default_rng(0)
    rows = [(7, 10 * b + i, 10 * b + j, float(1 + rng.random())) for b in range(3) for i in range(6) for j in range(i)]
    rows += [(7, 0, 10, 0.01), (7, 10, 20, 0.01), (8, 1, 2, 1.0)]
    e = spark.createDataFrame(rows, "graph long, u long, v long, w double")
    got = {(r.graph, r.node): r.cluster for r in spectral(e, 3, normalised=normalised).collect()}
    assert all(got[(7, 10 * b + i)] == 10 * b for b in range(3) for i in range(6)) and got[(8, 1)] == 1 and got[(8, 2)] == 2
    assert nearest_edges(e, 1).where("w < 0.1").count() == 0
    assert spectral(e.where("false"), 3).count() == 0
