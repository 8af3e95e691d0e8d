"""Leading eigenpairs of large symmetric walks, also of nearly disconnected ones: contracted levels, then a preconditioned block search."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from heatloom.functions.dense import top_eigen

#: Rows up to which a matrix is decomposed whole, and what a coarsest level has at most to be decomposed too.
COARSE, COARSEST = 600, 3000
#: Entries that connect nothing in double precision, and the least distance of a diagonal entry from 1.
NOTHING, LEAST_GAP = 1e-14, 1e-15
#: The gap from which a row is no longer nearly apart, and rounds after which images are computed anew.
APART, FRESH = 0.5, 20


class Walk(Protocol):
    """A symmetric matrix with eigenvalues in [-1, 1]."""

    n: int

    def times(self, block: np.ndarray) -> np.ndarray: ...

    def diagonal(self) -> np.ndarray: ...

    def strongest(self, least: float) -> np.ndarray:
        """Of each row the column of its largest entry beside the diagonal; the row itself where none is above ``least``."""

    def contracted(self, label: np.ndarray, share: np.ndarray, m: int) -> Walk:
        """P'WP for the matrix P of ``m`` columns that has ``share`` of each row in the column ``label``."""


@dataclass
class Level:
    """A walk, 1 less its diagonal, and the group of each row in the next level with the row's share of it."""

    walk: Walk
    gap: np.ndarray
    label: np.ndarray | None = None
    share: np.ndarray | None = None

    def down(self, x: np.ndarray) -> np.ndarray:
        order = np.argsort(self.label, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(self.label[order]) > 0])
        return np.add.reduceat((x * self.share[:, None])[order], starts, axis=0)

    def up(self, x: np.ndarray) -> np.ndarray:
        return x[self.label] * self.share[:, None]


def joined(point: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the groups that links from each place to ``point`` of it connect."""
    label, a = np.arange(len(point)), np.arange(len(point))
    while True:
        x, y = label[a], label[point]
        apart = x != y
        if not apart.any():
            return np.unique(label, return_inverse=True)[1].ravel()
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def levels_of(walk: Walk, null: np.ndarray) -> list[Level]:
    """The walk and its contractions: every row joins its strongest neighbour, until few rows or only components are left.

    ``null`` is the vector that the walk keeps within a component; each group's column is its part there, so that contraction
    keeps the components' own eigenvectors exactly.
    """
    levels = []
    while True:
        levels.append(Level(walk, np.maximum(1 - walk.diagonal(), LEAST_GAP)))
        if walk.n <= COARSE:
            return levels
        label = joined(walk.strongest(NOTHING))
        m = int(label.max()) + 1
        if m == walk.n:  # components
            return levels
        norm = np.sqrt(np.bincount(label, null**2, m))
        levels[-1].label, levels[-1].share = label, null / norm[label]
        walk, null = walk.contracted(label, levels[-1].share, m), norm


def preconditioned(levels: list[Level], coarse: tuple | None, r: np.ndarray, shift: float) -> np.ndarray:
    """About (1 + shift - walk)^-1 r: each level divides by its own gaps, the coarsest is solved where it was decomposed."""
    parts = []
    for level in levels:
        parts.append(r / (level.gap + shift)[:, None])
        if level.label is not None:
            r = level.down(r)
    if coarse:
        values, vectors = coarse
        parts[-1] = vectors @ ((vectors.T @ r) / (np.maximum(1 - values, 0) + shift)[:, None])
    x = parts.pop()
    for level, part in zip(reversed(levels[:-1]), reversed(parts), strict=True):
        x = part + level.up(x)
    return x


def beside(inner: np.ndarray, held: int) -> np.ndarray:
    """An orthonormal basis of what the columns of ``inner`` have beyond their first ``held`` entries, at right angles to all of them."""
    part = inner.copy()
    part[:held] = 0
    part = part - inner @ (inner.T @ part)
    size = np.linalg.norm(part, axis=0)
    left, kept, _ = np.linalg.svd(part[:, size > 1e-12] / size[size > 1e-12], full_matrices=False)
    left = left[:, kept > 1e-8]
    return np.linalg.qr(left - inner @ (inner.T @ left))[0]


def leading_pairs(walk: Walk, k: int, null: np.ndarray | None = None, start: np.ndarray | None = None, tol: float = 1e-6, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of ``walk``, descending.

    The search starts from the eigenvectors of the coarsest level, the single rows that are nearly apart on every level, and
    ``start``. A round adds the preconditioned residuals of the pairs that haven't settled and the last step's directions, and
    takes the best pairs of all (locally optimal block search, settled pairs locked), whose images follow from those of the
    directions: only the residuals are multiplied. After 40 rounds the block doubles. Once all residuals are below ``tol``, a
    fresh random block looks for pairs that have been missed; only if the values stay are they final. An error is
    raised where that doesn't happen.
    """
    n, rng = walk.n, np.random.default_rng(0)
    k = min(k, n)
    m = min(n, k + max(4, k // 4))
    if n <= max(COARSE, 3 * m):
        return top_eigen(walk.times(np.eye(n)), k)
    levels = levels_of(walk, np.ones(n) if null is None else null)
    last = levels[-1].walk
    coarse = top_eigen(last.times(np.eye(last.n)), last.n) if last.n <= COARSEST else None

    def lifted(x: np.ndarray, to: int) -> np.ndarray:
        for level in reversed(levels[:to]):
            x = level.up(x)
        return x

    first = [rng.standard_normal((n, 4))]
    if coarse:
        first.append(lifted(coarse[1][:, :m], len(levels) - 1))
    for at, level in enumerate(levels):
        apart = np.argsort(level.gap, kind="stable")[:m]
        apart = apart[level.gap[apart] < APART]
        single = np.zeros((level.walk.n, len(apart)))
        single[apart, np.arange(len(apart))] = 1
        first.append(lifted(single, at))
    if start is not None and len(start) == n:
        first.append(start)
    basis = np.linalg.qr(np.concatenate(first, axis=1)[:, :n])[0]
    images = walk.times(basis)
    values, inner = top_eigen(basis.T @ images, m)
    x, wx, steps, wsteps = basis @ inner, images @ inner, np.zeros((n, 0)), np.zeros((n, 0))
    settled, rest = None, np.inf
    for turn in range(rounds):
        gaps = wx - x * values
        sizes = np.linalg.norm(gaps, axis=0)
        rest, shift = float(sizes[:k].max()), max(1 - values[-1], 1e-12)
        if rest < tol:
            if settled is not None and np.abs(values[:k] - settled).max() < tol:
                return values[:k], x[:, :k]
            settled, steps, wsteps = values[:k].copy(), np.zeros((n, 0)), np.zeros((n, 0))
            new = preconditioned(levels, coarse, rng.standard_normal((n, m)), shift)
        else:
            new = preconditioned(levels, coarse, gaps[:, sizes > 0.3 * tol], shift)
        held, basis = x.shape[1], np.concatenate([x, steps], axis=1)
        for _ in range(3):  # the first leaves rounding, and where a column had no part of its own a direction that the others take apart
            new = new - basis @ (basis.T @ new)
            new = np.linalg.qr(new / np.maximum(np.linalg.norm(new, axis=0), 1e-300))[0]
        basis, images = np.concatenate([basis, new], axis=1), np.concatenate([wx, wsteps, walk.times(new)], axis=1)
        values, inner = top_eigen(basis.T @ images, m)
        x, wx = basis @ inner, images @ inner
        inner_steps = beside(inner, held)
        steps, wsteps = basis @ inner_steps, images @ inner_steps
        if turn % 40 == 39:  # slow: pairs beyond the wanted ones are too close to them
            m = max(m, min(n // 4, 2 * m))
        if turn % FRESH == FRESH - 1:  # rounding
            both = np.linalg.qr(np.concatenate([x, steps], axis=1))[0]
            images = walk.times(both)
            x, steps, wx, wsteps = both[:, : x.shape[1]], both[:, x.shape[1] :], images[:, : x.shape[1]], images[:, x.shape[1] :]
    raise FloatingPointError(f"eigenpairs of the full graph left a residual of {rest:.1e} after {rounds} rounds")
