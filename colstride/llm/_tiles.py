"""Tiles: bounded groups of rows whose members are compared with each other in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_tile(batches_: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of rows with the same ``tile``; rows come sorted by it."""
    held: list[dict] = []

    def joined(parts: list[dict]) -> dict:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if len(parts) > 1 else parts[0]

    for batch in batches_:
        if not batch.num_rows:
            continue
        columns = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if pa.types.is_binary(column.type):
                values = np.empty(len(column), dtype=object)
                values[:] = column.to_pylist()
            else:
                values = column.to_numpy(zero_copy_only=False)
            columns[name] = values
        tile = columns["tile"]
        edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(edges, edges[1:]):
            part = {k: v[a:b] for k, v in columns.items()}
            if held and held[0]["tile"][0] != part["tile"][0]:
                yield joined(held)
                held = []
            held.append(part)
    if held:
        yield joined(held)


def tiled(rows: DataFrame, schema: str, work: Callable[[dict[str, np.ndarray]], list[np.ndarray] | None]) -> DataFrame:
    """Run ``work`` on the rows of each tile, dealt out by tile; it returns columns or None."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        for group in by_tile(batches_):
            if (got := work(group)) is not None:
                out.append(got)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tile").sortWithinPartitions("tile", "side", "id").mapInArrow(run, schema)
