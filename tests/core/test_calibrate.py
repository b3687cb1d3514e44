"""Isotonic fit by ranges and its interpolation, against a plain pass over sorted points."""

import numpy as np
import pytest

from tessera.operators import calibrate as C


def plain(points):
    """Blocks [x mean, y mean] of (x, y, w), one after the other."""
    cells: dict[float, list[float]] = {}
    for x, y, w in points:
        c = cells.setdefault(x, [0.0, 0.0, 0.0])
        c[0], c[1], c[2] = c[0] + x * w, c[1] + y * w, c[2] + w
    out: list[list[float]] = []
    for x in sorted(cells):
        now = cells[x]
        while out and out[-1][1] * now[2] > now[1] * out[-1][2]:
            now = [a + b for a, b in zip(out.pop(), now)]
        out.append(now)
    return np.array([[sx / w, sy / w] for sx, sy, w in out])


def shapes(rng):
    yield "falling", [(float(i), float(i < 150), 1.0) for i in range(300)]
    yield "rising", [(float(i), float(i > 150), 1.0) for i in range(300)]
    yield "teeth", [(float(i), float(i % 60), 1.0) for i in range(300)]  # each range rises, every cut falls
    yield "noise", [(float(x), float(y), float(w)) for x, y, w in zip(rng.integers(0, 400, 600), rng.integers(0, 2, 600), rng.integers(1, 4, 600))]
    yield "ties", [(1.0, float(i % 2), 1.0) for i in range(50)]


@pytest.mark.parametrize("rows", [60, 200_000])
def test_blocks_do_not_depend_on_the_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "RANGE_ROWS", rows)
    cases = dict(shapes(np.random.default_rng(5)))
    points = spark.createDataFrame([(g, x, y, w) for g, ps in cases.items() for x, y, w in ps], "g string, x double, y double, w double")
    blocks = C.isotonic_blocks(points)
    got = blocks.toPandas()
    ask = [-5.0, 0.0, 0.5, 1.0, 33.3, 150.0, 299.0, 1000.0]
    read = C.calibrated(spark.createDataFrame([(g, x) for g in cases for x in ask], "g string, x double"), blocks).toPandas()
    fits = C.isotonic(points).toPandas()
    for g, ps in cases.items():
        want = plain(ps)
        b = got[got.g == g].sort_values("lo")
        knots = [k for x0, x1, y in zip(b.x0, b.x1, b.y) for k in [(x0, y), (x1, y)][: 1 + (x1 > x0)]]
        ends = [k for i, k in enumerate(want) if not (0 < i < len(want) - 1 and want[i - 1][1] == k[1] == want[i + 1][1])]  # the inner ones of a flat stretch tell nothing
        assert np.allclose(knots, ends)
        r = read[read.g == g].sort_values("x")
        assert np.allclose(r.p, np.interp(r.x, want[:, 0], want[:, 1]))
        f = fits[fits.g == g].sort_values("x")
        assert len(f) == len({x for x, _, _ in ps}) and (f.fit.diff().dropna() >= 0).all()
        assert all(abs(v - b[(b.lo <= x) & (b.hi >= x)].y.iloc[0]) < 1e-5 for x, v in zip(f.x, f.fit))


def test_defined_results(spark):
    rows = [(None, 1.0, 1.0, 1.0), (None, 2.0, 0.0, 1.0), ("a", None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0), ("a", 1.0, None, 1.0), ("a", 1.0, 1.0, 0.0), ("a", -0.0, 0.0, 2.0), ("a", 0.0, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "g string, x double, y double, w double")
    blocks = C.isotonic_blocks(points)
    assert sorted((r.g or "", r.lo, r.hi, r.y, r.w) for r in blocks.collect()) == [("", 1.0, 2.0, 0.5, 2.0), ("a", 0.0, 0.0, 0.5, 4.0)]
    asked = spark.createDataFrame([(1, None, 9.0, "k"), (2, "a", None, "k"), (3, "a", float("nan"), "k"), (4, "none", 1.0, "k"), (5, "a", 7.0, "k"), (6, "a", 7.0, "k")], "id long, g string, x double, below string")
    assert [(r.id, r.p) for r in C.calibrated(asked, blocks).orderBy("id").collect()] == [(1, 0.5), (2, None), (3, None), (4, None), (5, 0.5), (6, 0.5)]
    assert C.isotonic_blocks(points.limit(0)).count() == 0 and C.isotonic(points.limit(0)).count() == 0
    assert {r.p for r in C.calibrated(asked, blocks.limit(0)).collect()} == {None}
