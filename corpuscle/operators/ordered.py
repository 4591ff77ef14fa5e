"""Running values and folds of groups in order, where one group may be a large part of the table.

A window that runs over a group's rows has one task for the group. Here rows are dealt out by ranges of (group, order), so a large group lies in
many parts; each part runs over its own rows, and what earlier parts of a group add up to is joined to them from a table with a row a part and
group.

A fold whose steps can't be put together, such as a sum that passes over what doesn't fit or an average rounded at each step, has no such totals.
But where its state is one of a few thousand whole numbers, a part can go through its first group once for all states that it may begin with:
they soon run into one another, and what is left is a short list of which beginning leads to which end. Those lists are put together in order
of parts, a row a part; then every part knows the state it begins with and folds its rows one by one. State is one number throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from corpuscle.sources import store

PART = "_part"


def in_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` as a table in ranges of (group, order), with its range's number in column PART."""
    dealt = df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id())
    return store.write_table(dealt, store.new_path(df.sparkSession, "ranges"))


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """``df`` with, by new name, sums and maxima of columns over a group's rows up to each one in ``order``, which has no ties within a group."""
    wanted = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.max) for n, c in (maxima or {}).items()]
    parts = in_ranges(df, group, order)
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*group, PART).agg(*(f(c).alias(f"_{n}") for n, c, f in wanted))
    carried = totals.select(*group, PART, F.count("*").over(before).alias("_parts"), *(f(f"_{n}").over(before).alias(f"_{n}") for n, _, f in wanted)).where("_parts > 0").drop("_parts")
    local = parts.withColumns({n: f(c).over(inside) for n, c, f in wanted}).join(carried, [*group, PART], "left")
    both = {n: F.greatest(n, f"_{n}") if f is F.max else F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(F.coalesce(n, F.lit(0)) + F.col(f"_{n}")) for n, _, f in wanted}
    return local.withColumns(both).drop(PART, *(f"_{n}" for n, _, _ in wanted))


class _Ends:
    """The state a run of rows ends with, by the state it begins with."""

    def __init__(self, begin: np.ndarray):
        self.now, self.of = np.unique(begin, return_inverse=True)
        self.steps = 0

    def step(self, advance: Callable[[np.ndarray, tuple], np.ndarray], row: tuple) -> None:
        self.now = advance(self.now, row)
        self.steps += 1
        if len(self.now) > 1 and self.steps % 8 == 0:
            self.now, place = np.unique(self.now, return_inverse=True)
            self.of = place[self.of]

    def changes(self) -> tuple[list[int], list[int]]:
        """Places among the beginnings where the end differs from the one before, and the ends from there on."""
        ends = self.now[self.of]
        at = np.concatenate(([0], np.flatnonzero(np.diff(ends)) + 1))
        return at.tolist(), ends[at].tolist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def folded(df: DataFrame, group: list[str], order: list[str], values: list[str], states: int, first: int, advance: Callable[[np.ndarray, tuple], np.ndarray]) -> DataFrame:
    """``df`` with longs ``before`` and ``after``: the state of a fold over each group's rows in ``order``, which has no ties within a group.

    States are whole numbers below ``states``, ``first`` at a group's beginning; ``advance(states, row)`` gives the states after a row of the columns
    ``values`` for an array of states before it. Groups are not null.
    """
    parts = in_ranges(df, group, order)
    keys, wanted = [PART, *group], len(group)
    sort = [PART, *group, *order]
    dealt = parts.select(*keys, *values, *order).repartition(PART).sortWithinPartitions(*sort)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys).schema)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's first group, for all states it may begin with, and its last one, if another, from ``first``."""
        made: list[tuple] = []
        last, run, opening = None, None, False
        for row in _rows(batches):
            key = row[: wanted + 1]
            if key != last:
                if last is not None and (opening or key[0] != last[0]):
                    made.append((last, *run.changes(), opening))
                opening = last is None or key[0] != last[0]
                run, last = _Ends(np.arange(states) if opening else np.array([first])), key
            run.step(advance, row[wanted + 1 : wanted + 1 + len(values)])
        if last is not None:
            made.append((last, *run.changes(), opening))
        columns = [pa.array([m[0][i] for m in made], f.type) for i, f in enumerate(key_schema)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array([m[3] for m in made], pa.bool_())], names=[*keys, "at", "ends", "opening"])

    key_schema = to_arrow_schema(parts.select(*keys).schema)
    ends = store.write_table(dealt.mapInArrow(borders, f"{kinds}, at array<long>, ends array<long>, opening boolean"), store.new_path(df.sparkSession, "borders"))

    def carry(table: pa.Table) -> pa.Table:
        """Of one group the state that each of its parts begins with."""
        rows = table.sort_by(PART)
        state, begins = first, []
        for at, end, opening in zip(rows.column("at").to_pylist(), rows.column("ends").to_pylist(), rows.column("opening").to_pylist(), strict=True):
            begins.append(state)
            state = end[int(np.searchsorted(at, state, "right")) - 1] if opening else end[0]
        return rows.select(keys).append_column("begins", pa.array(begins, pa.int64()))

    many = ends.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    begins = ends.join(many, group, "left_semi").groupBy(*group).applyInArrow(carry, f"{kinds}, begins long")
    begins = store.write_table(begins, store.new_path(df.sparkSession, "begins"))
    known = parts.join(begins, keys, "left").select(parts.columns + ["begins"]).repartition(PART).sortWithinPartitions(*sort)
    place = [known.columns.index(c) for c in keys]
    where = [known.columns.index(c) for c in values]
    schema = StructType([*df.schema.fields, StructField("before", LongType()), StructField("after", LongType())])
    kept = [known.columns.index(c) for c in df.columns]
    target = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.array([first])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (*place, *where)]
            begin, before, after = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for n, row in enumerate(zip(*columns, strict=True)):
                if row[: wanted + 1] != last:
                    last = row[: wanted + 1]
                    state = np.array([first if begin[n] is None else begin[n]])
                before.append(int(state[0]))
                state = advance(state, row[wanted + 1 :])
                after.append(int(state[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(before, pa.int64()), pa.array(after, pa.int64())], schema=target)

    return known.mapInArrow(fold, schema)
