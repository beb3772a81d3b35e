"""Runs of equal keys in Arrow batches that are sorted by the key, whatever batch they end in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: int, most_held: int = 1 << 17
) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Tables that end where a run of the first ``keys`` columns ends.

    A run of more than ``most_held`` rows comes in several tables: the first flag says that the
    table's first run began in the table before, the second that its last run goes on.
    """
    held: list[pa.RecordBatch] = []
    rows, last_key, goes_on = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        key = tuple(values[0].item() for values in columns)
        if held and key != last_key:
            yield pa.Table.from_batches(held), goes_on, False
            held, rows, goes_on = [], 0, False
        elif goes_on and not held and key != last_key:
            goes_on = False
        last_key = tuple(values[-1].item() for values in columns)
        differ = np.zeros(batch.num_rows - 1, bool)
        for values in columns:
            differ |= values[1:] != values[:-1]
        at = np.flatnonzero(differ)
        if len(at):
            cut = int(at[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]), goes_on, False
            batch, held, rows, goes_on = batch.slice(cut), [], 0, False
        held.append(batch)
        rows += batch.num_rows
        if rows > most_held:
            yield pa.Table.from_batches(held), goes_on, True
            held, rows, goes_on = [], 0, True
    if held:
        yield pa.Table.from_batches(held), goes_on, False
