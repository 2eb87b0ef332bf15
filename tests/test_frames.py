import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismview import frames as fr
from prismview.functions import cosmology
from prismview.operators import curves, search
from prismview.spec import CatSpec, ViewSpec


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_random_frames_and_geodesics_stay_orthonormal(seed):
    rng = np.random.default_rng(seed)
    a, b = fr.random_frame(7, rng), fr.random_frame(7, rng)
    assert fr.orthonormality_error(a) < 1e-12
    assert np.allclose(fr.geodesic(a, b, 0), a) and np.allclose(fr.geodesic(a, b, 1), b)
    for t in np.linspace(0, 1, 11):
        assert fr.orthonormality_error(fr.geodesic(a, b, float(t))) < 1e-9
    # continuous at the ends
    assert np.abs(fr.geodesic(a, b, 1e-6) - a).max() < 1e-4
    assert np.abs(fr.geodesic(a, b, 1 - 1e-6) - b).max() < 1e-4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.floats(-0.7, 0.7), st.floats(-0.7, 0.7))
def test_manual_rotation_hits_its_target(seed, x, y):
    f = fr.random_frame(6, np.random.default_rng(seed))
    g = fr.rotated_to(f, 2, (x, y))
    assert np.allclose(g[2], (x, y), atol=1e-6) and fr.orthonormality_error(g) < 1e-9


def test_combos_round_trip():
    dims = {"a": (1.0, 2.0), "b": (0.0, 0.5), "c": (3.0, 1.0)}
    f, bad = fr.frame_from_combos({"a": 1.0, "b": -0.5}, {"c": 1.0}, dims)
    assert not bad
    back = fr.column_combo(f[:, 0], dims)
    assert abs(back["b"] / back["a"] + 0.5) < 1e-12
    assert fr.frame_from_combos({"a": 1.0}, {"a": 2.0}, dims)[1]


def test_ticks_and_fades():
    assert fr.ticks(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert fr.fade_factors(np.array([[0.06, 0], [0.5, 0.5]])).tolist() == pytest.approx([0.5, 0])


def test_view_spec():
    v = ViewSpec((("a", 1.0),), (("b", 0.5), ("c", -0.5)), "d", (("a", 0.0, 1.5),), (("k", (1, 3)),), ("d",))
    assert ViewSpec.from_query_string(v.to_query_string()) == ViewSpec(v.x, v.y, v.color, v.ranges, v.masks, v.need)
    assert v.with_axis("y", "a").x == v.y
    assert v.toggled("k", 1, (1, 2, 3)).masks == (("k", (3,)),)
    assert v.toggled("k", 2, (1, 2, 3), solo=True).toggled("k", 2, (1, 2, 3), solo=True).masks == ()
    assert CatSpec.normalized({"key": "k", "codes": {"2": "two", "9": "no", "1": "one"}}, 0).codes == ((1, "one"), (2, "two"))


def test_cosmology_known_values():
    assert cosmology.kpc_per_arcsec(0.1) == pytest.approx(1.8443, rel=2e-3)
    assert cosmology.comoving_distance(0.0) == 0


def test_search_finds_the_helper_and_skips_copies():
    rng = np.random.default_rng(5)
    n = 6000
    m, s, noise = rng.standard_normal(n), rng.standard_normal(n), rng.standard_normal(n)
    y = np.tanh(m + 0.32 * s) + 0.03 * rng.standard_normal(n)
    got = search.tighten(np.column_stack([m, s, noise, m + 0.01 * noise]), y, 0)
    assert got["chosen"][:2] == [0, 1] and got["coef"][1] == pytest.approx(0.32, abs=0.05) and got["improved"]
    idle = search.tighten(np.column_stack([m, noise]), np.tanh(m) + 0.1 * rng.standard_normal(n), 0)
    assert idle["chosen"] == [0]


def test_running_scatter_is_invariant_to_the_axis():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, 20_000)
    y = np.tanh(x) + 0.1 * rng.standard_normal(20_000)
    a, b = search.running_scatter(x, y)[0], search.running_scatter(-3 * x + 7, y)[0]
    assert a == pytest.approx(0.1, abs=0.008) and b == pytest.approx(a, rel=0.03)


def test_curves():
    assert curves.root(lambda v: v * v - np.array([2.0, 3.0]), [0, 0], [2, 2]).tolist() == pytest.approx([2 ** 0.5, 3 ** 0.5])
    p = curves.by_arclength([(0, 0), (3, 4), (3, 14)], 4)
    assert p == [(0.0, 0.0), (3.0, 4.0), (3.0, 9.0), (3.0, 14.0)]
