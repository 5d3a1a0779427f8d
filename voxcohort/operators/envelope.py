"""Exact squared distances along scan lines, as the lower envelope of one parabola a source.

A line is one row: where its sources stand and what they cost, and where the minimum of ``weight * (place - source)^2 + cost`` is asked
for. All lines of a batch advance in step, so the work is linear in sources plus questions (each source enters and leaves the
envelope at most once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the padded tables of lines that are held at a time; a longer line is held alone.
CELLS = 1 << 20


def _padded(values: np.ndarray, ends: np.ndarray, kind=np.float64) -> np.ndarray:
    size = np.diff(ends)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), kind)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def _minima(place: np.ndarray, cost: np.ndarray, size: np.ndarray, asked: np.ndarray, asks: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Minima of padded lines with at least one source; ``place`` and ``asked`` rise within a line, ``size`` falls from line to line."""
    lines = np.arange(len(size))
    held = np.zeros(place.shape, np.int64)  # sources of the envelope from left to right
    begin = np.full(place.shape, -np.inf)  # where each is the lowest from
    top = np.zeros(len(size), np.int64)
    for k in range(1, place.shape[1]):
        some = int(np.searchsorted(-size, -k))  # lines with more than k sources
        cross = np.empty(some)
        open_lines = lines[:some]
        while len(open_lines):
            at = top[open_lines]
            other = held[open_lines, at]
            a, b = place[open_lines, other], place[open_lines, k]
            with np.errstate(divide="ignore", invalid="ignore"):  # a weight of 0 leaves costs alone
                meet = (a + b) / 2 + (cost[open_lines, k] - cost[open_lines, other]) / (2 * weight[open_lines] * (b - a))
            cross[open_lines] = np.nan_to_num(meet, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            open_lines = open_lines[(cross[open_lines] <= begin[open_lines, at]) & (at > 0)]
            top[open_lines] -= 1
        at = top[:some]
        over = cross == -np.inf  # lower than the first everywhere
        top[:some] = at + ~over
        held[lines[:some], top[:some]] = k
        begin[lines[:some], top[:some]] = cross
    out = np.zeros(asked.shape)
    now = np.zeros(len(size), np.int64)
    last = held.shape[1] - 1
    for m in range(asked.shape[1]):
        open_lines = lines[asks > m]
        while len(open_lines):
            ahead = np.minimum(now[open_lines] + 1, last)
            open_lines = open_lines[(now[open_lines] < top[open_lines]) & (begin[open_lines, ahead] < asked[open_lines, m])]
            now[open_lines] += 1
        best = held[lines, now]
        gap = asked[:, m] - place[lines, best]
        out[:, m] = gap * gap * weight + cost[lines, best]
    return out


def line_minima(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (kept columns, sources array of (at, cost), asked array, weight) become (kept columns, asked, minima), lines without
    sources are left out; both arrays of a result rise."""
    names = [*kept, "asked", "minima"]
    for batch in batches:
        found = batch.column(batch.schema.get_field_index("sources"))
        asked = batch.column(batch.schema.get_field_index("asked"))
        weight = np.asarray(batch.column(batch.schema.get_field_index("weight")), float)
        ends, asks = (np.append(0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64) for c in (found, asked))
        flat, question = found.flatten(), np.asarray(asked.flatten(), float)
        at, cost = np.asarray(flat.field("at"), float), np.asarray(flat.field("cost"), float)
        line = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        order = np.lexsort((cost, at, line))
        line, at, cost = line[order], at[order], cost[order]
        # of several sources at one place the cheapest counts
        fresh = np.ones(len(at), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1])
        line, at, cost = line[fresh], at[fresh], cost[fresh]
        size = np.bincount(line, minlength=batch.num_rows)
        ends = np.append(0, np.cumsum(size))
        question = question[np.lexsort((question, np.repeat(np.arange(batch.num_rows), np.diff(asks))))]
        by_size = np.argsort(-size, kind="stable")
        by_size = by_size[size[by_size] > 0]
        step = max(1, CELLS // max(1, int(size.max(initial=0)), int(np.diff(asks).max(initial=0))))
        for low in range(0, len(by_size), step):
            rows = by_size[low: low + step]
            pick = lambda values, bounds: np.concatenate([values[bounds[r]: bounds[r + 1]] for r in rows])
            own, n = np.append(0, np.cumsum(size[rows])), np.diff(asks)[rows]
            asked_ends = np.append(0, np.cumsum(n))
            questions = _padded(pick(question, asks), asked_ends)
            best = _minima(_padded(pick(at, ends), own), _padded(pick(cost, ends), own), size[rows], questions, n, weight[rows])
            valid = np.arange(questions.shape[1]) < n[:, None]
            offsets, taken = pa.array(asked_ends.astype(np.int32)), batch.take(pa.array(rows))
            yield pa.record_batch([*(taken.column(taken.schema.get_field_index(c)) for c in kept),
                                   pa.ListArray.from_arrays(offsets, pa.array(questions[valid].astype(np.int64))),
                                   pa.ListArray.from_arrays(offsets, pa.array(best[valid]))], names)


def pair_minima(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (kept columns, points and targets arrays of (x, y, z), weights _u0.._u2) become (kept columns, _e array of (x, y, z, d2)),
    every point once."""
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023,E731
        sides = []
        for name in ("points", "targets"):
            lists = column(name)
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            flat = lists.flatten()
            sides.append((ends, np.stack([np.asarray(flat.field(c), np.int64) for c in "xyz"], axis=1)))
        weights = np.stack([np.asarray(column(f"_u{i}"), float) for i in range(3)], axis=1)
        (asks, points), (ends, targets) = sides
        found, best = [], []
        for row in range(batch.num_rows):
            asked, (ux, uy, uz) = np.unique(points[asks[row]: asks[row + 1]], axis=0), weights[row]
            p, (x, y, z) = asked.astype(float), targets[ends[row]: ends[row + 1]].astype(float).T
            step = max(1, CELLS // max(1, len(x)))
            least = np.empty(len(p))
            for low in range(0, len(p), step):
                part = p[low: low + step, :, None]
                gaps = part[:, 0] - x, part[:, 1] - y, part[:, 2] - z
                least[low: low + step] = (gaps[0] * gaps[0] * ux + (gaps[1] * gaps[1] * uy + gaps[2] * gaps[2] * uz)).min(axis=1)
            found.append(asked)
            best.append(least)
        if not found:
            continue
        flat, offsets = np.concatenate(found), np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
        entries = pa.StructArray.from_arrays([*(pa.array(flat[:, i]) for i in range(3)), pa.array(np.concatenate(best))], ["x", "y", "z", "d2"])
        yield pa.record_batch([*(column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), entries)], [*kept, "_e"])
