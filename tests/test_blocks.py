"""Packed blocks of the shared Newton fits."""

import numpy as np
import pandas as pd
import pytest

from paneloom.operators import newton


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 900
    z, m = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(z - 0.4 * z * m + np.maximum(z - 0.2, 0))))).astype(float)
    times = rng.integers(0, 3, (n, 4)).tolist()
    return pd.DataFrame({"grp": np.where(np.arange(n) % 3, "a", "b"), "z": z, "monitor": m, "label": y, "weight": 1.0 + np.arange(n) % 2, "times": times})


KINDS = "grp string, z double, monitor double, label double, weight double, times array<int>"


def test_blocks_hold_one_group_and_every_row_once(spark, rows, monkeypatch):
    monkeypatch.setattr(newton, "BLOCK", 100)
    blocks = newton.packed(spark.createDataFrame(rows, KINDS).repartition(3), "grp", "times").collect()
    assert len(blocks) < 30  # a pass reads a few blocks, not rows
    for g, part in rows.groupby("grp"):
        mine = [b for b in blocks if b["grp"] == g]
        assert sorted(v for b in mine for v in b["z"]) == sorted(part.z)
        assert np.sum([np.reshape(b["times"], (-1, 4)).sum(0) for b in mine], 0).tolist() == np.sum(part.times.tolist(), 0).tolist()


def test_fits_with_and_without_a_hinge_share_their_passes(spark, rows):
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    points = {"a": [(0, 0.1), (3, -0.5), (3, newton.NOWHERE)], "b": [(2, newton.NOWHERE)]}
    got = newton.fit_many(df, "grp", points, newton.hinge_design, 6, 0.7, times="times")
    assert len(got) == 4
    for r in got.itertuples():
        part = rows[rows.grp == r.grp]
        plain = r.point == newton.NOWHERE
        x = newton.interaction_design(part, 0) if plain else newton.hinge_design(part, r.point)
        w = part.weight.to_numpy() * np.array([t[r.rep] for t in part.times])
        y, b = part.label.to_numpy(), np.zeros(x.shape[1])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-x @ b))
            b -= np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + 0.7 * np.eye(len(b)), x.T @ (w * (mu - y)) + 0.7 * b)
        assert [r.b0, r.b1, r.b2, r.b3, r.b4, r.b5] == pytest.approx([*b, 0, 0] if plain else list(b), abs=1e-9)
        eta = x @ b
        assert r.loss == pytest.approx((w * (np.logaddexp(0, eta) - y * eta)).sum() / w.sum(), abs=1e-10)
