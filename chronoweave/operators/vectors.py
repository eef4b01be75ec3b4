"""Weighted moments of whole vectors in one aggregate.

A state is the weights' sum, the mean vector and the vector of summed squared deviations from it.  Rows are states of one row each, states
of a key merge exactly (the deviations between the states' means are added), and merging is the same step before the shuffle, where it
takes what a task has read of a key, and after it.  So a feature dimension is no row of its own, a hot key arrives as a few states, and
large means with small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a task holds before it hands them on.
HELD_STATES = 16_384


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Equal keys to equal numbers; null is a key like any other."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        each = c.combine_chunks().dictionary_encode()
        each = each.combine_chunks() if isinstance(each, pa.ChunkedArray) else each
        index = each.indices.fill_null(len(each.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(each.dictionary) + 1) + index, return_inverse=True)[1].reshape(-1)
    return code


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(flat) != size * len(column):
        raise ValueError("the vectors of one aggregate must have one length")
    return flat.reshape(len(column), size).astype(float)


def merged(states: pa.Table, keys: int, sums: int, lists: int) -> pa.Table:
    """One state for each key: columns are the keys, weight, mean, m2, then sums, then lists."""
    if not states.num_rows:
        return states
    order = np.argsort(_codes([states.column(i) for i in range(keys)]), kind="stable")
    code = _codes([states.column(i) for i in range(keys)])[order]
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    states = states.take(pa.array(order))
    weight = states.column(keys).to_numpy().astype(float)
    lengths = states.column(keys + 1).combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    size = int(lengths.max())
    # A state without weight may have no vectors, as a masked row has.
    has = lengths == size
    if size and not (has | (lengths == 0) & (weight == 0)).all():
        raise ValueError("the vectors of one aggregate must have one length")
    mean, m2 = np.zeros((len(code), size)), np.zeros((len(code), size))
    held = states.filter(pa.array(has))
    mean[has], m2[has] = _matrix(held.column(keys + 1), size), _matrix(held.column(keys + 2), size)
    mean[weight == 0], m2[weight == 0] = 0.0, 0.0
    total = np.add.reduceat(weight, begins)
    group = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
    # Means are taken from the first state's, so that large ones don't swallow small differences.
    first = np.full(len(begins), len(code))
    np.minimum.at(first, group[weight > 0], np.flatnonzero(weight > 0))
    origin = np.where((first < len(code))[:, None], mean[np.minimum(first, len(code) - 1)], 0.0)
    share = np.divide(weight, total[group], out=np.zeros_like(weight), where=total[group] > 0)[:, None]
    new_mean = origin + np.add.reduceat(share * (mean - origin[group]) * (weight > 0)[:, None], begins, axis=0) if size else mean[begins]
    new_m2 = np.add.reduceat(m2 + weight[:, None] * (mean - new_mean[group]) ** 2, begins, axis=0) if size else m2[begins]
    offsets = np.arange(len(begins) + 1, dtype=np.int32) * size
    out = [states.column(i).take(pa.array(begins)).combine_chunks() for i in range(keys)]
    out += [pa.array(total), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1))) for x in (new_mean, new_m2))]
    out += [pa.array(np.add.reduceat(states.column(keys + 3 + i).to_numpy().astype(float), begins)) for i in range(sums)]
    for i in range(lists):
        column = states.column(keys + 3 + sums + i).combine_chunks()
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends[np.append(begins[1:], len(code)) - 1]).astype(np.int32)), column.flatten()))
    return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], schema=states.schema)


def _before(keys: int, sums: int, lists: int):
    """States of what a task has read so far of each key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = merged(pa.Table.from_batches([b]), keys, sums, lists)
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > HELD_STATES:
                held = merged(held, keys, sums, lists)
                if held.num_rows > HELD_STATES // 2:
                    yield from held.combine_chunks().to_batches()
                    held = None
        if held is not None:
            yield from merged(held, keys, sums, lists).combine_chunks().to_batches()

    return run


def _after(keys: int, sums: int, lists: int):
    """One state for each key, of states in order of their key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            now = now if held is None else pa.concat_tables([held, now])
            codes = _codes([now.column(i) for i in range(keys)])
            last = np.flatnonzero(codes == codes[-1])
            done = merged(now.slice(0, int(last[0])), keys, sums, lists)
            held = merged(now.slice(int(last[0])), keys, sums, lists)  # its key may go on in the next batch
            yield from done.combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def vector_moments(df: DataFrame, by: list[str], vector: str, weight: str, sums: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """``(by, weight, mean, m2, sums, lists)``: weighted mean and summed squared deviations of an array column, by key.

    ``sums`` are numbers to be added up and ``lists`` columns to be gathered, in the same pass.  Rows of weight 0 count in these alone,
    whatever their vectors hold; of a key without weight, mean and m2 are zeros, or empty if no vector came.
    """
    keys = by or ["all_"]
    rows = df if by else df.withColumn("all_", F.lit(0))
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    on = F.col(weight) > 0
    states = rows.select(
        *keys, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight"), F.when(on, numbers).otherwise(F.array().cast("array<double>")).alias("mean"),
        F.when(on, F.transform(vector, lambda x: F.lit(0.0))).otherwise(F.array().cast("array<double>")).alias("m2"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums), *(F.array(c).alias(c) for c in lists),
    )
    schema = states.schema
    shape = (len(keys), len(sums), len(lists))
    partial = states.mapInArrow(_before(*shape), schema)
    whole = partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_after(*shape), schema)
    return whole if by else whole.drop("all_")
