import pytest
from pyspark.sql import functions as F

from trajscope.functions import sequences as sq


def _array(values):
    return F.array(*(F.lit(float(v)) for v in values))


def _curve(points):
    return F.array(*(F.struct(F.lit(f).alias("f"), F.lit(float(v)).alias("v")) for f, v in points))


@pytest.fixture(scope="module")
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_zigzag(one):
    points = [(0, 1), (2, 0.6), (4, 0.68), (6, 0.2), (8, 0.5), (10, 0.45)]
    got = one(sq.descents(_curve(points), F.lit(0.16)))
    assert [(d["start"], d["end"], round(d["depth"], 9)) for d in got] == [(0, 6, 0.8), (8, 10, 0.05)]


def test_zigzag_at_the_threshold(one):
    got = one(sq.descents(_curve([(0, 1), (2, 0.6), (4, 0.8)]), F.lit(0.2)))
    assert [(d["start"], d["end"], round(d["depth"], 9)) for d in got] == [(0, 2, 0.4)]


def test_no_descent_in_a_rise(one):
    assert one(sq.descents(_curve([(0, 0), (1, 1), (2, 2)]), F.lit(0.0))) == []
    assert one(sq.steepest(sq.descents(_curve([(0, 0), (1, 1)]), F.lit(0.0)))) is None


def test_steepest_breaks_ties(one):
    d = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(0.5).alias("depth")) for s, e in ((10, 20), (30, 35), (5, 10))))
    got = one(sq.steepest(d))
    assert (got["start"], got["end"]) == (5, 10)


def test_drawdown(one):
    assert one(sq.drawdown(_array([0.1, 0.9, 0.3, 0.5, 0.1]))) == pytest.approx(0.8)
    assert one(sq.drawdown(_array([1, 2, 3]))) == 0


@pytest.mark.parametrize("v,w,expected", [([0, 2, 1], [1, 2, 3], 1 / 13), ([1, 1, 1], [1, 1, 1], 0), ([0, 1, 2], [1, 1, 1], 1), ([2, 1, 0], [1, 2, 1], -1)])
def test_direction(one, v, w, expected):
    assert one(sq.direction(_array(v), _array(w))) == pytest.approx(expected)


def test_folds(one):
    assert one(sq.signed_fold(_array([0.5, -0.2]))) == pytest.approx(0.4)
    assert one(sq.progress_fold(_array([0.5, 0.5]))) == pytest.approx(0.75)
    assert one(sq.softmax_progress(_array([0, 0, 0, 0, 0]))) == pytest.approx(0.5)
    assert one(sq.cosine(_array([1, 0]), _array([1, 1]))) == pytest.approx(0.5**0.5)
    assert one(sq.cosine(_array([0, 0]), _array([1, 1]))) is None
