import pytest
from pyspark.sql import functions as F

from trajscope.functions import frames as fr


@pytest.fixture(scope="module")
def one(spark):
    def run(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return run


L = F.lit


def test_edges(one):
    assert one(fr.tail_frames(L(101))) == [98, 99, 100]
    assert one(fr.head_frames(L(101))) == [0, 1, 2]
    assert one(fr.head_frames(L(1))) == [0]


def test_grid_with_end(one):
    assert one(fr.grid_with_end(L(100), L(10.0))) == [*range(0, 100, 2), 99]
    assert one(fr.grid_with_end(L(100), L(12.0)))[:6] == [0, 2, 5, 7, 10, 12]


def test_stage_grid_rounds_half_to_even(one):
    assert set(one(fr.stage_grid(L(0), L(25), L(25.0)))) >= {0, 2, 5, 8, 10, 12, 15, 18, 20, 22}


@pytest.mark.parametrize("start,end", [(1, 4), (30, 50), (31, 100), (31, 33)])
def test_top_up_and_weights(one, start, end):
    frames = one(fr.top_up(fr.stage_grid(L(start), L(end), L(30.0)), L(start), L(end)))
    assert len(frames) >= min(10, end - start) and frames == sorted(set(frames))
    weights = one(fr.time_weights(F.array(*map(L, frames)), L(start), L(end)))
    assert sum(weights) == pytest.approx(end - start)


def test_top_up_ties(one):
    assert one(fr.top_up(F.array(L(30), L(33), L(36)), L(30), L(38))) == list(range(30, 38))
    assert one(fr.top_up(F.array(L(3)), L(1), L(4))) == [1, 2, 3]
    assert one(fr.top_up(F.expr("cast(array() as array<int>)"), L(31), L(33))) == [31, 32]


def test_cycle(one):
    assert one(fr.mirror(fr.strided(L(35), 10))) == [0, 10, 20, 30, 34, 30, 20, 10, 0]
    assert one(fr.mirror(F.array(L(11), L(50), L(90)))) == [11, 50, 90, 50, 11]


def test_playback(one):
    positions = one(F.transform(F.sequence(L(0), fr.timeline_anchor(L(100), L(97), L("cycle"))), lambda p: fr.source_frame(L(100), p, L("cycle"))))
    assert positions == [*range(100), 98, 97]
    positions = one(F.transform(F.sequence(L(0), fr.timeline_anchor(L(100), L(97), L("reverse"))), lambda p: fr.source_frame(L(100), p, L("reverse"))))
    assert positions == [99, 98, 97]


@pytest.mark.parametrize("start,end,fps,expected", [(10, 110, 30.0, [(10, 109), (14, 105), (19, 100), (24, 95)]), (100, 200, 25.0, [(100, 199), (104, 195), (108, 191), (111, 188)])])
def test_boundary_pairs(one, start, end, fps, expected):
    assert [tuple(p) for p in one(fr.boundary_pairs(L(start), L(end), L(fps)))] == expected


def test_middle_window_and_prefixes(one):
    assert tuple(one(fr.middle_window(L(10), L(20)))) == (12, 18)
    assert tuple(one(fr.middle_window(L(10), L(11)))) == (10, 11)
    assert one(fr.prefix_uniform(L(2), 4)) == [0, 1, 2, 2]
    assert one(fr.prefix_uniform(L(10), 4)) == [0, 3, 7, 10]
    assert one(fr.prefix_floor(L(10), 4)) == [0, 3, 6, 10]
    assert one(fr.last_frames(F.array(L(1), L(2)), 3)) == [1, 1, 2]
