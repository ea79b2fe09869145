"""Places and running sums over whole tables or hot groups, by prefix sums over ranges.

Rows are dealt by ranges of their keys and order (``in_ranges``), so a group with a third of all rows lies in many
partitions, each sorted. ``running_sum`` adds up inside each partition and needs from the others only the totals of the
groups that start or end there: two rows a partition, whatever the input. No group meets in one task, and the plan holds no
cut points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.session import cut_lineage

PART = "__part"


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows, sorted by keys and order (nulls first) over partitions whose number stands in ``__part``.

    A reliable checkpoint, as sampled range bounds may differ when a lost partition is computed again. ``then`` works on the sorted
    partitions before they are stored and must keep their rows in order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    out = then(out) if then else out
    return cut_lineage(out.withColumn(PART, F.spark_partition_id()))


def run_starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple | None, bool]:
    """(first row of every run of equal keys, the keys of the last row, whether the first run goes on from ``last``). Nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    for column in columns:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = True
    going = last is not None and last == tuple(c[0].as_py() for c in columns)
    return np.flatnonzero(new), tuple(c[-1].as_py() for c in columns), going


def running_sum(ranged: DataFrame, keys: list[str], value: str | None, name: str) -> DataFrame:
    """``ranged`` with the sum of ``value`` (None: the number of rows) over a group's rows up to each one.

    Sums are 64-bit and wrap around. A null value counts as 0.
    """
    fields = [f for f in ranged.schema if f.name != name]
    slim = ranged.select(PART, *keys, *([value] if value else []))

    def values(batch: pa.RecordBatch) -> np.ndarray:
        if value is None:
            return np.ones(batch.num_rows, np.int64)
        return batch.column(batch.schema.get_field_index(value)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)

    def edges(batches):
        """Totals of a partition's first run and, where it is another, its last."""
        part, last, total, runs, first = None, None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            starts, end, going = run_starts(batch, keys, last)
            sums = np.add.reduceat(values(batch), starts)
            if not going:
                if runs == 1:
                    first = (last, total)
                runs += 1
                total = 0
            if len(starts) > 1 and runs == 1:
                first = (tuple(batch.column(1 + k)[0].as_py() for k in range(len(keys))), _wrap(total + int(sums[0])))
            runs += len(starts) - 1
            total, last = _wrap((total if len(starts) == 1 else 0) + int(sums[-1])), end
        if part is not None:
            found = [(first, True), ((last, total), False)] if runs > 1 else [((last, total), True)]
            yield pa.RecordBatch.from_pylist([{PART: part, "leads": lead, "alone": runs == 1, "total": t, "key": repr(k)} for (k, t), lead in found], schema=edge_schema)

    edge_schema = pa.schema([(PART, pa.int32()), ("leads", pa.bool_()), ("alone", pa.bool_()), ("total", pa.int64()), ("key", pa.string())])
    found = slim.mapInArrow(edges, f"{PART} int, leads boolean, alone boolean, total long, key string").collect()  # two rows a partition
    before, open_key, open_total = {}, None, 0
    for row in sorted(found, key=lambda r: (r[PART], not r.leads)):
        if row.leads and row.key == open_key:
            before[row[PART]] = open_total
            open_total = _wrap(open_total + row.total)
        else:
            open_key, open_total = row.key, row.total

    def sums(batches):
        last, carry, start = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, end, going = run_starts(batch, keys, last)
            if start:
                carry, going, start = before.get(batch.column(batch.schema.get_field_index(PART))[0].as_py(), 0), True, False
            amounts = values(batch)
            through = np.cumsum(amounts)
            lengths = np.diff(np.append(starts, batch.num_rows))
            base = through[starts] - amounts[starts]
            if going:
                base[0] -= carry
            out = through - np.repeat(base, lengths)
            carry, last = out[-1], end
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in fields], pa.array(out)], [*[f.name for f in fields], name])

    schema = ranged.select(*[f.name for f in fields]).withColumn(name, F.lit(0).cast("long")).schema
    return ranged.mapInArrow(sums, schema)


def _wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def rank_within(rows: DataFrame, group: str | list[str], order: str | list[str], name: str = "rank") -> DataFrame:
    """1-based place of every row in its group by ``order``, which should be a total order; null groups are one group."""
    keys, order = [group] if isinstance(group, str) else list(group), [order] if isinstance(order, str) else list(order)
    return running_sum(in_ranges(rows, keys, order), keys, None, name).drop(PART)
