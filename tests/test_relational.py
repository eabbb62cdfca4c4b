"""NOT IN by three-valued logic, and sketches, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import relational, sketches


def three_valued(row, other):
    """True, False or None: whether two rows are equal."""
    parts = [None if a is None or b is None else a == b for a, b in zip(row, other, strict=True)]
    return False if False in parts else None if None in parts else True


@pytest.mark.parametrize("right", [[], [(1, 1)], [(None, 1), (2, 2)], [(None, None)], [(1, None), (2, 2), (2, 2)]])
def test_not_in_of_two_columns(spark, right):
    left = [*itertools.product([1, 2, None], [1, 2, None]), (1, 1)]
    df = spark.createDataFrame([(a, b, "x") for a, b in left], "a int, b int, _pattern string")
    other = spark.createDataFrame(right, "x int, y int")
    got = sorted(((r.a, r.b) for r in relational.not_in(df, other, ["a", "b"], ["x", "y"]).collect()), key=str)
    assert got == sorted((r for r in left if all(three_valued(r, o) is False for o in right)), key=str)


def test_not_in_of_one_column_of_one_name(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (2,)], "a int")
    take = lambda *r: sorted((x.a for x in relational.not_in(left, spark.createDataFrame([(v,) for v in r], "a int"), ["a"]).collect()), key=str)
    assert take(1) == [2, 2] and take(1, None) == [] and take() == [1, 2, 2, None] and take(3) == [1, 2, 2]


def test_sketches_merge(spark):
    draw = random.Random(6)
    rows = [("a" if draw.random() < 0.8 else "b", d, draw.randrange(4000), draw.gauss(0, 1)) for d in range(5) for _ in range(4000)] + [("c", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, user int, value double")
    stored = sketches.sketched(df, ["g", "day"], "user", "value")
    got = {r.g: r for r in sketches.estimates(sketches.merged(stored, ["g"]), ["g"], (0.1, 0.5, 0.9)).collect()}
    for g in "ab":
        users, values = {u for k, _, u, _ in rows if k == g}, sorted(v for k, _, _, v in rows if k == g)
        assert abs(got[g].distinct - len(users)) < 0.05 * len(users) and got[g].rows == len(values)
        for share, q in zip((0.1, 0.5, 0.9), got[g].quantiles, strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - share) < 0.03
    assert got["c"].distinct == 0 and got["c"].quantiles is None and got["c"].rows == 1
    assert sketches.estimates(sketches.merged(stored.limit(0), ["g"]), ["g"]).count() == 0 and df.count() == len(rows)
    assert sketches.merged(sketches.merged(stored, ["g", "day"]), ["g"]).select(F.sum("rows")).first()[0] == len(rows)
