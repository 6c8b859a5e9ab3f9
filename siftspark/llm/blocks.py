"""Streaming over rows sorted by a key inside a task: groups found in Arrow batches, large groups put off.

Used by the joins on signatures: a partition holds sorted (key, ...) rows; groups of one are skipped,
small groups are compared at once, and groups over a limit are returned as they are, so that a second
pass deals them out as pairs of chunks. No group is ever held whole beyond the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


#: Rows looked at together, so that the work for each size of group is shared.
ROWS_TOGETHER = 80_000


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int, derived: dict[str, Callable] | None = None) -> Iterator[tuple[str, dict[str, np.ndarray], np.ndarray]]:
    """("groups", columns, starts) for runs of whole groups, all of at least two rows, and ("large", columns, _) for rows of groups over limit.

    Batches must be sorted by keys; derived ones are made from a batch's columns. starts holds each group's first row, and the number of rows at its end.
    """
    held: dict[str, np.ndarray] | None = None
    overflow = None  # the key of a group whose rows are being put off
    for some in _together(batches):
        cols = {n: np.concatenate([column(b, n) for b in some]) for n in some[0].schema.names}
        cols |= {n: f(cols) for n, f in (derived or {}).items()}
        if overflow is not None:
            same = np.logical_and.reduce([cols[k] == v for k, v in zip(keys, overflow, strict=True)])
            end = int(np.argmin(same)) if not same.all() else len(same)
            if end:
                yield "large", {n: c[:end] for n, c in cols.items()}, np.empty(0, int)
            if end == len(same):
                continue
            cols, overflow = {n: c[end:] for n, c in cols.items()}, None
        if held is not None:
            cols = {n: np.concatenate([held[n], c]) for n, c in cols.items()}
        if not len(cols[keys[0]]):
            continue
        new = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = int(starts[-1])
        yield from _whole({n: c[:last] for n, c in cols.items()}, starts, limit)
        held = {n: c[last:] for n, c in cols.items()}
        if len(held[keys[0]]) > limit:
            yield "large", held, np.empty(0, int)
            overflow, held = tuple(held[k][0] for k in keys), None
    if held is not None:
        n = len(held[keys[0]])
        yield from _whole(held, np.array([0, n]), limit)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= ROWS_TOGETHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def _whole(cols: dict[str, np.ndarray], starts: np.ndarray, limit: int) -> Iterator[tuple[str, dict[str, np.ndarray], np.ndarray]]:
    size = np.diff(starts)
    for kind, keep in (("large", size > limit), ("groups", (size > 1) & (size <= limit))):
        if keep.any():
            rows = np.repeat(keep, size)
            at = np.concatenate([[0], np.cumsum(size[keep])])
            yield kind, {n: c[: starts[-1]][rows] for n, c in cols.items()}, at


def small_pairs(starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i before j, of all pairs inside groups of up to most rows, a group size at a time."""
    size = np.diff(starts)
    for g in np.unique(size[size <= most]):
        i, j = np.triu_indices(int(g), 1)
        first = starts[:-1][size == g]
        step = max(1, 1_000_000 // max(1, len(i)))
        for a in range(0, len(first), step):
            yield (first[a : a + step, None] + i).ravel(), (first[a : a + step, None] + j).ravel()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def in_pieces(make: Callable[..., pa.RecordBatch], *columns, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), rows):
        yield make(*(c[a : a + rows] for c in columns))
