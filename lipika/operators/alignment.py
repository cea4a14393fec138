"""Global alignment of cluster sequences (C22): the one row-level dynamic program."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of score tables held at once.
CELLS = 500_000


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a best alignment: +1 for equal, -1 for a substitution or gap; diagonal before up before left.

    A row of the score table at a time: the diagonal and upper candidates are
    array operations, the left one is a running maximum.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    code = {c: i for i, c in enumerate(dict.fromkeys((*a, *b)))}
    x, y = np.array([code[c] for c in a]), np.array([code[c] for c in b])
    score = np.empty((n + 1, m + 1), np.int32)
    score[0] = -np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = -i
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], 1, -1), score[i - 1, 1:] - 1)
        score[i] = np.maximum.accumulate(best + step) - step
    i, j, out = n, m, []
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def substitutions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows``' first column with true_cluster, predicted_cluster, gt_index and pred_index for each substitution.

    Null arrays count as empty and give no rows; equal clusters are left out.
    """
    key = rows.columns[0]
    kind = dict(rows.dtypes)[key]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            keys, xs, ys = (c.to_pylist() for c in batch.columns)
            pairs = [(x or [], y or []) for x, y in zip(xs, ys)]
            for k, (x, y), found in zip(keys, pairs, aligned_many(pairs)):
                for i, j in found:
                    if x[i] != y[j]:
                        for col, v in zip(out, (k, x[i], y[j], i, j)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32())], [key, "true_cluster", "predicted_cluster", "gt_index", "pred_index"])

    return rows.select(key, F.col(a), F.col(b)).mapInArrow(align, f"{key} {kind}, true_cluster string, predicted_cluster string, gt_index int, pred_index int")


def _common_end(a: list[str], b: list[str]) -> int:
    most = min(len(a), len(b))
    return next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)


def aligned_many(pairs: list[tuple[list[str], list[str]]]) -> list[list[tuple[int, int]]]:
    """:func:`aligned` of each pair, for many pairs of like lengths in lockstep."""
    out: list[list[tuple[int, int]]] = [[] for _ in pairs]
    ends = [_common_end(a, b) for a, b in pairs]  # equal ends are aligned with each other in a best alignment, by the first choice
    whole, pairs = pairs, [(a[: len(a) - e], b[: len(b) - e]) for (a, b), e in zip(pairs, ends)]
    todo = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    code: dict[str, int] = {}
    s = 0
    while s < len(todo):
        n = m = 0
        e = s
        while e < len(todo):
            n2, m2 = max(n, len(pairs[todo[e]][0])), max(m, len(pairs[todo[e]][1]))
            if e > s and (e + 1 - s) * (n2 + 1) * (m2 + 1) > CELLS:
                break
            n, m, e = n2, m2, e + 1
        mine = todo[s:e]
        s = e
        x, y = np.full((len(mine), n), -1, np.int32), np.full((len(mine), m), -2, np.int32)
        for r, k in enumerate(mine):
            a, b = pairs[k]
            x[r, : len(a)] = [code.setdefault(c, len(code)) for c in a]
            y[r, : len(b)] = [code.setdefault(c, len(code)) for c in b]
        kind = np.int16 if n + m < 30_000 else np.int32
        score, step = np.empty((len(mine), n + 1, m + 1), kind), np.arange(m + 1, dtype=kind)
        hit, miss = kind(1), kind(-1)
        score[:, 0] = -step
        for i in range(1, n + 1):
            best = score[:, i - 1] - hit
            np.maximum(best[:, 1:], score[:, i - 1, :-1] + np.where(y == x[:, i - 1, None], hit, miss), out=best[:, 1:])
            score[:, i] = np.maximum.accumulate(best + step, axis=1) - step
        row = np.arange(len(mine))
        i, j = np.array([len(pairs[k][0]) for k in mine]), np.array([len(pairs[k][1]) for k in mine])
        steps = []
        while len(row):
            here = score[row, i, j]
            diag = here == score[row, i - 1, j - 1] + np.where(x[row, i - 1] == y[row, j - 1], 1, -1)
            up = ~diag & (here == score[row, i - 1, j] - 1)
            steps.append((row[diag], i[diag] - 1, j[diag] - 1))
            i, j = i - (diag | up), j - (diag | ~up)
            go = (i > 0) & (j > 0)
            row, i, j = row[go], i[go], j[go]
        for r, i, j in reversed(steps):
            for k, u, v in zip(r.tolist(), i.tolist(), j.tolist()):
                out[mine[k]].append((u, v))
    for found, (a, b), e in zip(out, whole, ends):
        found += zip(range(len(a) - e, len(a)), range(len(b) - e, len(b)))
    return out


def read_as(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows``' first column with true_cluster, predicted_cluster and n: each cluster of ``a`` and what it is aligned with, null if with nothing.

    Null arrays count as empty. Counts are those of a batch, to be added up.
    """
    key = rows.columns[0]
    kind = dict(rows.dtypes)[key]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, x, y = (c.to_pylist() for c in batch.columns)
            pairs = [(u or [], v or []) for u, v in zip(x, y)]
            count: Counter = Counter()
            for k, (u, v), found in zip(keys, pairs, aligned_many(pairs)):
                read = dict(found)
                count.update((k, c, v[read[i]] if i in read else None) for i, c in enumerate(u))
            cols = list(zip(*count)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(list(count.values()), pa.int64())], [key, "true_cluster", "predicted_cluster", "n"])

    return rows.select(key, F.col(a), F.col(b)).mapInArrow(align, f"{key} {kind}, true_cluster string, predicted_cluster string, n long")
