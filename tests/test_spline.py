import numpy as np
import pytest

from lacuna.operators import spline


def dense(x, y, at):
    """The spline by one full system in the basis of quadratic B-splines (Cox-de Boor)."""
    n = len(x)
    middle = (x[1:] + x[:-1]) / 2
    t = np.r_[[x[0]] * 3, middle[1:-1], [x[-1]] * 3]

    def basis(v):
        b = np.array([float(t[i] <= v < t[i + 1]) for i in range(len(t) - 1)])
        if v == t[-1]:
            b[:] = 0
            b[n - 1] = 1.0
        for k in (1, 2):
            new = np.zeros(len(b) - 1)
            for i in range(len(new)):
                a = (v - t[i]) / (t[i + k] - t[i]) * b[i] if t[i + k] > t[i] else 0
                c = (t[i + k + 1] - v) / (t[i + k + 1] - t[i + 1]) * b[i + 1] if t[i + k + 1] > t[i + 1] else 0
                new[i] = a + c
            b = new
        return b

    c = np.linalg.solve(np.array([basis(v) for v in x]), y)
    return np.array([basis(v) @ c for v in at])


def holed(seed, n, missing):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n).cumsum()
    y[rng.random(n) < missing] = np.nan
    return y


@pytest.mark.parametrize(("seed", "missing", "chunk"), [(2, 0.7, 512), (3, 0.6, 16), (4, 0.9, 3)])
def test_like_one_full_system(series, column, seed, missing, chunk):
    y = holed(seed, 300, missing)
    got = column(spline.quadratic_spline(series(a=[None if np.isnan(v) else v for v in y]), chunk_points=chunk))
    known = np.flatnonzero(~np.isnan(y))
    for i in range(300):
        if known[0] <= i <= known[-1]:
            assert got[i] == pytest.approx(dense(known.astype(float), y[known], [float(i)])[0], abs=1e-7)
        else:
            assert got[i] is None


def test_days_instead_of_rows(spark, series, column):
    frame = series(a=[1.0, 4.0, None, 2.0, None, 7.0, 3.0]).filter("obs_date <> date'2020-01-05'")
    got = column(spline.quadratic_spline(frame, axis="day"))
    x, y = np.array([0.0, 1, 3, 5, 6]), np.array([1.0, 4, 2, 7, 3])
    assert got[2] == pytest.approx(dense(x, y, [2.0])[0])
    rows = column(spline.quadratic_spline(frame))
    assert rows[2] == pytest.approx(dense(np.array([0.0, 1, 3, 4, 5]), y, [2.0])[0])


def test_few_points(series, column):
    frame = series(a=[None, 3.0, None, None, 9.0, None], b=[5.0, None], c=[None, None], d=[1.0, None, 9.0, None, 25.0])
    made = spline.quadratic_spline(frame)
    assert column(made, location="a") == [None, 3.0, pytest.approx(5.0), pytest.approx(7.0), 9.0, None]
    assert column(made, location="b") == [5.0, None] and column(made, location="c") == [None, None]
    assert column(made, location="d") == pytest.approx([1.0, 4.0, 9.0, 16.0, 25.0])


def test_a_parabola_is_met_exactly(series, column):
    values = [float((i - 70) ** 2) / 7 for i in range(200)]
    some = [v if i % 7 in (0, 1, 4) else None for i, v in enumerate(values)]
    got = column(spline.quadratic_spline(series(a=some), chunk_points=10))
    assert got[:198] == pytest.approx(values[:198])


def test_long_gaps_between_short_ones_stay_stable(series, column):
    """Distances of very different size: no growth along the series, whatever the chunk."""
    places = np.unique(np.concatenate([np.arange(k, 3000, 97) for k in (0, 1, 2, 50)]))
    y = np.sin(places / 40)
    values = [None] * 3000
    for i, v in zip(places, y, strict=True):
        values[i] = float(v)
    one, two = (column(spline.quadratic_spline(series(a=values), chunk_points=c)) for c in (7, 512))
    last = int(places[-1])
    assert one[: last + 1] == pytest.approx(two[: last + 1], abs=1e-8)
    assert one[: last + 1] == pytest.approx(dense(places.astype(float), y, np.arange(last + 1.0)), abs=1e-7)
