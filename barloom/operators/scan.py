"""Sequential passes over series in the order of their rows, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Columns(dict):
    """The columns of a batch, converted when asked for: numbers as floats (null: NaN), others as lists."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self.batch = batch

    def __missing__(self, name: str):
        c = self.batch.column(self.batch.schema.get_field_index(name))
        plain = pa.types.is_integer(c.type) or pa.types.is_floating(c.type)
        self[name] = c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) if plain else c.to_pylist()
        return self[name]


def scan(df: DataFrame, schema: T.StructType, start: Callable[[], Callable], head: int = 1) -> DataFrame:
    """df, with the columns of schema that a step over its series makes or replaces.

    start() gives a series' step, which keeps what it needs of the rows before: called with the Columns of
    the next rows it returns their new columns (NaN: null). The first call has at least `head` rows, or the whole
    series. One shuffle by series, which windows below share; rows then stream in Arrow batches, so a task holds a
    batch and the head of one series, however long that is. Columns that no step asks for stay Arrow arrays.
    """
    # numbers from 1 in each series: they tell where one starts, and that none is out of order
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy("series").orderBy("ord"))).sortWithinPartitions("series", "_at")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, begun, seen, done = None, [], False, 0, []

        def give() -> None:
            if not held:
                return
            batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            with np.errstate(all="ignore"):
                new = step(Columns(batch))
            old = batch.schema
            arrays = [pa.array(new[n], from_pandas=True) if n in new else batch.column(old.get_field_index(n)) for n in names]
            done.append(pa.RecordBatch.from_arrays(arrays, names))

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(batch.schema.get_field_index("_at")).to_numpy()
            edges = np.unique(np.r_[0, np.flatnonzero(at == 1), len(at)]).tolist()
            for i, j in zip(edges, edges[1:]):
                if at[i] == 1:
                    give()  # the series before was shorter than the head
                    step, begun, seen = start(), False, 0
                if step is None or not np.array_equal(at[i:j], np.arange(seen + 1, seen + j - i + 1)):
                    raise RuntimeError("rows of a series came out of order")
                seen += j - i
                held.append(batch.slice(i, j - i))
                if begun or seen >= head:
                    give()
                    begun = True
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done.clear()
        give()
        yield from done

    return rows.mapInArrow(run, schema)
