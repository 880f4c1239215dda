import numpy as np
import pandas as pd
import pytest

from understory.plans import jobs


def growth_frame(spark, grows=True):
    r = np.random.default_rng(7)
    n = 800
    pdf = pd.DataFrame({"x": r.random(n) * 5000, "y": r.random(n) * 5000, "kind": r.choice(["oak", "fir"], n), "grp": "forest", "start": r.uniform(2, 30, n), "slope": r.random(n) * 30})
    pdf["end"] = pdf.start + (2 + (pdf.kind == "oak") + 0.05 * pdf.slope if grows else 0) + r.normal(0, 0.3, n)
    return spark.createDataFrame(pdf)


def test_growth_gate_passes_only_with_growth(spark):
    got = jobs.growth_gate(growth_frame(spark), {"all": "true", "oak": "kind = 'oak'"}, 500, 50, draws=300)
    assert got["decision"] == "PASS" and got["screens"]["all"]["mae_prior"] < 1 < got["screens"]["all"]["mae_no_change"]
    assert jobs.growth_gate(growth_frame(spark, False), {"all": "true"}, 500, 50, draws=300)["decision"] == "FAIL"


def test_residual_gate_finds_the_slope(spark):
    got = jobs.residual_gate(growth_frame(spark), ["slope"], ["kind"], 500, 50, folds=3)
    assert got["decision"] == "PASS" and got["mae_model"] < got["mae_prior"]


def test_noise_floor(spark):
    r = np.random.default_rng(0)
    i, j = np.mgrid[0:60, 0:60]
    start = r.random((60, 60)) * 20
    cells = spark.createDataFrame(pd.DataFrame({"tile": 0, "row": i.ravel(), "col": j.ravel(), "start": start.ravel(), "end": (start + r.normal(0, 0.2, (60, 60))).ravel()}))
    limits = {"sigma": 0.3, "bias": 0.1, "decay": 0.5, "tolerance": 0.1, "scales": 3, "r2": 0.8}
    got = jobs.noise_floor(cells, (1, 2, 4), 10, limits, 3)
    assert all(got["checks"].values()) and got["rows"][0]["nmad"] == pytest.approx(0.2, abs=0.02)
    with pytest.raises(KeyError):
        jobs.noise_floor(cells, (1,), 10, {}, 3)


def test_builds_resume_and_record_failures(spark):
    df = spark.createDataFrame([(k, 2 - k) for k in range(4)], "tile int, d int")
    first = jobs.build(df, ["tile"], lambda job: {"value": 6.0 / job["d"]}, "value double")
    rows = {r.tile: (r.value, r.status) for r in first.collect()}
    assert rows == {0: (3.0, "done"), 1: (6.0, "done"), 2: (None, "failed"), 3: (-6.0, "done")}
    assert [r.tile for r in jobs.todo(df, first, ["tile"]).collect()] == [2]


def test_lattice_covers_the_box(spark):
    got = jobs.tile_lattice(spark, (-122.3, 38.7, -122.2, 38.75), 500).toPandas()
    assert got.x1.max() == -122.2 and got.y1.max() == 38.75 and (got.x1 > got.x0).all()
    assert ((got.x1 - got.x0) * (got.y1 - got.y0)).sum() == pytest.approx(0.1 * 0.05)


def test_records(spark):
    assert jobs.signature({"b": 1, "a": 2}) == jobs.signature({"a": 2, "b": 1})
    assert jobs.interval_text({"difference": -0.1214, "ci_low": -0.145, "ci_high": -0.097}) == "-0.121 [-0.145, -0.097]"
    assert jobs.markdown(spark.createDataFrame([(1, 2.0, None)], "a int, b double, c string")).splitlines()[-1] == "| 1 | 2.000 | - |"
    assert jobs.array_gib((1024, 1024, 1024), 4) == 4.0


@pytest.mark.parametrize("dx,dy", [(0.6, -0.4), (-1.2, 0.8)])
def test_alignment_finds_planted_shift(spark, dx, dy):
    i, j = np.mgrid[0:48, 0:48]
    h = lambda r, c: 40 * np.sin(r / 7) + 30 * np.cos(c / 6) + 12 * np.sin((r + c) / 9)
    cells = spark.createDataFrame(pd.DataFrame({"tile": 0, "row": i.ravel(), "col": j.ravel(), "start": h(i, j).ravel(), "end": (h(i + dy, j - dx) + 1.5).ravel()}))
    got = jobs.aligned(cells, 1.0, slopes=(5, 88))
    assert (got["dx"], got["dy"], got["dz"]) == (pytest.approx(dx, abs=0.02), pytest.approx(dy, abs=0.02), pytest.approx(1.5, abs=0.02)) and got["rounds"] < 5
