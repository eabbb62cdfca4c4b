"""Set operators with SQL's three-valued logic, by equi-joins."""

from __future__ import annotations

from itertools import combinations
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str] | None = None) -> DataFrame:
    """Rows of left for which `(keys) NOT IN (SELECT right_keys FROM right)` is true.

    An empty right side keeps all rows. Else a row goes if a right row equals it, or can't be told from it: wherever both are
    known they are equal. So rows are compared on the columns in which neither is null, a set of columns at a time: one left-anti
    equi-join for each subset of the keys, which is shuffled or broadcast as sizes are; Spark's own null-aware join
    broadcasts the right side whatever its size, and takes one key. Where no column is known on both sides, it is enough that
    there is such a right row, which at most a row for each pattern of nulls says. Repeated rows stay."""
    right_keys = right_keys or keys
    tag = lambda n: f"_{n}_{uuid4().hex[:8]}"  # noqa: E731  other columns can have any name
    pattern, values = tag("pattern"), [tag(f"k{i}") for i in range(len(keys))]
    known = lambda cols: sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    there = right.select(*(F.col(c).alias(v) for c, v in zip(right_keys, values, strict=True))).distinct().withColumn(pattern, known(values))
    out = left.withColumn(pattern, known(keys))
    every = range(1 << len(keys))
    for size in range(len(keys), -1, -1):
        for some in combinations(range(len(keys)), size):
            mask = sum(1 << i for i in some)
            # Which left patterns are compared on just these columns, by right pattern.
            pairs = [(of, to) for of in every for to in every if of & to == mask]
            which = F.array(*(F.when(F.col(pattern) == of, F.lit(to)) for of, to in pairs))
            kills = there.select(*(F.col(values[i]) for i in some), F.explode(F.filter(which, lambda t: t.isNotNull())).alias(pattern)).distinct()
            on = out[pattern] == kills[pattern]
            for i in some:
                on = on & (out[keys[i]] == kills[values[i]])
            out = out.join(kills if some else F.broadcast(kills), on, "left_anti")
    return out.drop(pattern)
