"""Sparse incidence matrices in CSR form, and their products by rows (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Products of non-zeros that one run of rows makes, about.
RUN = 1 << 22


@dataclass
class Csr:
    """Row i has the columns indices[indptr[i]:indptr[i + 1]], ascending, with those values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @classmethod
    def of_spans(cls, ends: np.ndarray, columns: int) -> Csr:
        """Rows that follow each other, each with ones from the end of the last to its own."""
        return cls(np.concatenate([[0], ends]), np.arange(columns), np.ones(columns, np.int64), columns)

    @classmethod
    def of_members(cls, member: np.ndarray, columns: int) -> Csr:
        """One column a row."""
        return cls(np.arange(len(member) + 1), member, np.ones(len(member), np.int64), columns)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.searchsorted(self.indices[order], np.arange(self.columns + 1)), rows[order], self.values[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product's non-zeros (row, column, value) in order, a run of rows at a time.

        A row of the product is the sum of the other's rows that this row's columns name, times its values.
        A single row with more than RUN products is a run of its own.
        """
        width = np.diff(other.indptr)
        cost = np.concatenate([[0], np.cumsum(width[self.indices])])
        row, n = 0, len(self.indptr) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(cost[self.indptr], cost[self.indptr[row]] + RUN, "right")) - 1)
            end = min(end, n)
            a, b = self.indptr[row], self.indptr[end]
            inner = self.indices[a:b]
            many = width[inner]
            rows = np.repeat(np.repeat(np.arange(row, end), np.diff(self.indptr[row : end + 1])), many)
            first = np.cumsum(many) - many
            take = np.arange(len(rows)) + np.repeat(other.indptr[inner] - first, many)
            columns, values = other.indices[take], other.values[take] * np.repeat(self.values[a:b], many)
            key = rows * np.int64(max(1, other.columns)) + columns
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, rows, columns, values = key[order], rows[order], columns[order], values[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield rows[new], columns[new], np.add.reduceat(values, new) if len(new) else values
            row = end

    def column_sums(self) -> np.ndarray:
        """The product of a row of ones with this matrix."""
        return np.bincount(self.indices, self.values, self.columns).astype(np.int64)
