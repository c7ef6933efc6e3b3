"""Frame-index columns: grids, edges, mirrors, windows and playback views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.cast("int")


def edge_size(n: Column) -> Column:
    """Two per cent of the frames, rounded up, at least one."""
    return F.greatest(F.lit(1), _int(F.ceil(n * F.lit(0.02))))


def head_frames(n: Column) -> Column:
    return F.sequence(F.lit(0), edge_size(n) - 1)


def tail_frames(n: Column) -> Column:
    return F.sequence(n - edge_size(n), n - 1)


def grid(n: Column, fps: Column, hz: float) -> Column:
    """Distinct rint(i * fps / hz) below n; halves round to even."""
    top = _int(F.ceil(n * F.lit(float(hz)) / fps)) + 1
    every = F.transform(F.sequence(F.lit(0), top), lambda i: _int(F.rint(i * fps / F.lit(float(hz)))))
    return F.array_distinct(F.filter(every, lambda f: f < n))


def grid_with_end(n: Column, fps: Column, hz: float = 5.0) -> Column:
    """Like grid, by a period computed first, and with the last frame."""
    period = fps / F.lit(float(hz))
    top = _int(F.ceil(n / period)) + 1
    every = F.transform(F.sequence(F.lit(0), top), lambda i: _int(F.rint(i * period)))
    return F.array_union(F.filter(F.array_distinct(every), lambda f: f < n), F.array(n - 1))


def on_grid(frame: Column, n: Column, fps: Column, hz: float = 5.0, with_end: bool = False) -> Column:
    """Whether a frame is on `grid` or `grid_with_end`: the places near frame * hz / fps are tried, the grid is not built."""
    near = F.floor(frame * F.lit(float(hz)) / fps)
    place = (lambda i: F.rint(i * (fps / F.lit(float(hz))))) if with_end else (lambda i: F.rint(i * fps / F.lit(float(hz))))
    hit = (place(near) == frame) | (place(near + 1) == frame) | ((near > 0) & (place(near - 1) == frame))
    return hit | (frame == n - 1) if with_end else hit


def stage_grid(start: Column, end: Column, fps: Column, hz: float = 10.0) -> Column:
    """Grid frames of the episode that fall into [start, end)."""
    return F.filter(grid(end, fps, hz), lambda f: f >= start)


def top_up(frames: Column, start: Column, end: Column, most: int = 10) -> Column:
    """Add the frame farthest from those chosen (the smallest on ties) until min(most, end - start) are there."""
    length = end - start
    seeded = F.when(F.size(frames) > 0, frames).otherwise(F.array(start))

    def distance(chosen: Column, f: Column) -> Column:
        return F.array_min(F.transform(chosen, lambda c: F.abs(c - f)))

    def step(chosen: Column, _: Column) -> Column:
        ranked = F.array_min(F.transform(F.sequence(start, end - 1), lambda f: F.struct((-distance(chosen, f)).alias("far"), f.alias("f"))))
        return F.when(F.size(chosen) >= F.least(F.lit(most), length), chosen).otherwise(F.concat(chosen, F.array(ranked["f"])))

    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.lit(most)), seeded, step))


def time_weights(frames: Column, start: Column, end: Column) -> Column:
    """Widths of the frames' cells: midpoints between neighbours, clipped to [start, end); they sum to end - start."""
    last = F.size(frames) - 1

    def width(f: Column, i: Column) -> Column:
        left = F.when(i == 0, start.cast("double")).otherwise((F.get(frames, i - 1) + f) / F.lit(2.0))
        right = F.when(i == last, end.cast("double")).otherwise((F.get(frames, i + 1) + f) / F.lit(2.0))
        return right - left

    return F.transform(frames, width)


def strided(n: Column, stride: int) -> Column:
    return F.array_union(F.sequence(F.lit(0), n - 1, F.lit(stride)), F.array(n - 1))


def mirror(frames: Column) -> Column:
    """Up and down again without repeating the peak."""
    return F.concat(frames, F.reverse(F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))))


def boundary_pairs(start: Column, end: Column, fps: Column, n: int = 4, step: float = 0.15) -> Column:
    """(before, after) frames that move inwards from both ends of a span, clamped at its middle."""
    most = F.floor((end - start - 2) / 2).cast("int")

    def pair(i: Column) -> Column:
        o = F.least(_int(F.rint(i * fps * F.lit(step))), most)
        return F.struct((start + o).alias("before"), (end - 1 - o).alias("after"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pair)


def middle_window(start: Column, end: Column) -> Column:
    """The middle 60 per cent [from, to) of a span; the whole span where that is empty."""
    length = end - start
    a, b = start + _int(F.ceil(length * F.lit(0.2))), start + _int(F.floor(length * F.lit(0.8)))
    return F.when(a < b, F.struct(a.alias("from"), b.alias("to"))).otherwise(F.struct(start.alias("from"), end.alias("to")))


def timeline_size(n: Column, playback: Column) -> Column:
    return F.when(playback == "cycle", 2 * n - 1).otherwise(n)


def timeline_anchor(n: Column, anchor: Column, playback: Column) -> Column:
    """Position of a source frame on the timeline of its playback; in a cycle on its way down."""
    return F.when(playback == "forward", anchor).when(playback == "reverse", n - 1 - anchor).otherwise(2 * (n - 1) - anchor)


def source_frame(n: Column, position: Column, playback: Column) -> Column:
    return F.when(playback == "forward", position).when(playback == "reverse", n - 1 - position).otherwise(F.when(position < n, position).otherwise(2 * (n - 1) - position))


def prefix_uniform(anchor: Column, most: int) -> Column:
    """most frames from 0 to anchor: all of them padded with the anchor if there are fewer, else rint-uniform."""
    short = F.concat(F.sequence(F.lit(0), anchor), F.array_repeat(anchor, F.greatest(most - anchor - 1, F.lit(0))))
    return F.when(anchor + 1 <= most, short).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: _int(F.rint(anchor * i / F.lit(float(most - 1))))))


def prefix_floor(anchor: Column, most: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(anchor * i / F.lit(most - 1)).cast("int"))


def last_frames(frames: Column, most: int) -> Column:
    """The last `most` of the frames, padded on the left with the first."""
    kept = F.slice(frames, F.greatest(F.size(frames) - most + 1, F.lit(1)), F.lit(most))
    return F.concat(F.array_repeat(F.get(kept, F.lit(0)), F.greatest(most - F.size(kept), F.lit(0))), kept)
