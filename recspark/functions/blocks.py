"""Rows of a task by block: vectors of many rows laid end to end as bytes, and products of whole blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Users whose products with a block of items are held at once.
TILE_ROWS = 512
# Pairs whose vectors are gathered at once.
GATHERED_PAIRS = 65536


def runs(stream: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Neighbouring rows with the same whole number in ``key``."""
    held, at = [], None
    for batch in stream:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            if held and keys[a] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[a].item()
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values = column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(u: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the named rows of ``u`` and ``v``, each summed in one order in double precision."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), GATHERED_PAIRS):
        part = slice(a, a + GATHERED_PAIRS)
        out[part] = np.einsum("nk,nk->n", u[rows[part]].astype(np.float64, copy=False),
                              v[cols[part]].astype(np.float64, copy=False))
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("nk,nk->n", x, x, dtype=np.float64))


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the set places, some times faster than over two dimensions."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def rough_products(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """``rows, products, error`` for some rows of ``u`` at a time: all products with ``v`` in single
    precision, and by how much those of a row may be off at most (twice the bound of a sum of products)."""
    size_u, size_v = lengths(u), np.fmax.reduce(lengths(v), initial=0.0)
    kind = np.float32 if np.fmax.reduce(size_u, initial=0.0) * size_v < 1e30 else np.float64
    error = 2 * (u.shape[1] + 4) * np.finfo(kind).eps * size_u * size_v
    right = v.astype(kind, copy=False).T
    for a in range(0, len(u), TILE_ROWS):
        part = slice(a, a + TILE_ROWS)
        yield part, u[part].astype(kind, copy=False) @ right, error[part]
