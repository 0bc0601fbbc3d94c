import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.functions import clustering as C
from quadrat.functions import imaging as I
from quadrat.functions import points as P

RNG = np.random.default_rng(3)


def test_grayscale_channel_order():
    data = bytes([10, 20, 30])
    assert I.grayscale(data, 1, 1)[0, 0] == pytest.approx(0.299 * 30 + 0.587 * 20 + 0.114 * 10)
    assert I.grayscale(data, 1, 1, "RGB")[0, 0] == pytest.approx(0.299 * 10 + 0.587 * 20 + 0.114 * 30)


def test_gradient_is_one_sided_at_borders():
    a = np.array([[0.0, 1, 4]] * 3)
    dx, dy = I.gradient(a)
    raw = np.array([1.0, 2.0, 3.0])
    assert np.allclose(dx, raw / (1 + raw)) and np.allclose(dy, 0)


@pytest.mark.parametrize("shape", [(2, 2), (3, 3), (5, 8), (1, 4)])
def test_zero_mean_of_parities(shape):
    a = I.zero_mean(RNG.random(shape))
    for p in (0, 1):
        for part, axis in ((a[p::2], 0), (a[:, p::2], 1)):
            if part.size:
                assert np.allclose(part.mean(axis=axis), 0, atol=1e-12)


def test_box_mean_against_loops():
    a = RNG.random((9, 7))
    for size in (3, 5, 7, 9):
        r = size // 2
        want = [[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].sum() / size**2 for x in range(7)] for y in range(9)]
        assert np.allclose(I.box_mean(a, size), want)


def test_wiener_keeps_noise_and_removes_a_wave():
    y, x = np.mgrid[:32, :32]
    noise, wave = RNG.normal(size=(32, 32)), 8 * np.sin(2 * np.pi * x * 4 / 32)
    out = I.wiener(noise + wave)
    peak = lambda a: I.power(a)[0, 4]
    assert peak(out) < peak(noise + wave) and out.shape == (32, 32)


def test_pce_tells_a_shifted_copy():
    a, b = RNG.normal(size=(48, 64)), RNG.normal(size=(48, 64))
    assert I.pce(a, np.roll(a, (3, 5), (0, 1))) > 100 > 40 > I.pce(a, b)
    assert np.isnan(I.pce(a[:8, :8], a[:8, :8]))
    c = I.cross_correlation(a, b)
    assert c[2, 3] == pytest.approx((a * np.roll(b, (-2, -3), (0, 1))).sum())


@pytest.mark.parametrize("shape", [(16, 18), (15, 13), (32, 32)])
@pytest.mark.parametrize("mirror", ["hermitian", "row"])
def test_packed_spectra_give_the_same_as_whole_transforms(shape, mirror):
    h, w = shape
    a = RNG.normal(size=(5, h, w))
    packed = np.stack([I.packed_spectrum(x) for x in a])
    got = I.pce_block(h, w, "last" if mirror == "row" else "max", mirror)(packed[:3], packed)
    for i in range(3):
        for j in range(5):
            c = np.conj(np.fft.fft2(a[i])) * np.fft.fft2(a[j])
            if mirror == "row":
                for k in range(w // 2 + 1, w):
                    c[:, k] = np.conj(c[:, w - k])
            v = np.fft.ifft2(c).real
            y, x = np.unravel_index(np.abs(v).argmax(), v.shape)
            near = (np.abs(np.arange(h) - y) < 5)[:, None] & (np.abs(np.arange(w) - x) < 5)[None, :]
            value = v[-1, -1] if mirror == "row" else v[y, x]
            assert got[i, j] == pytest.approx(value**2 / ((v[~near] ** 2).sum() / (h * w - 121)))


def test_kernels_in_steps(monkeypatch):
    a, b, s = RNG.random((30, 2)), RNG.random((20, 2)), RNG.random(30) + 0.1
    whole = P.gauss_transform(a, b, 0.7), P.exp_dist(a, b, s, s[:20])
    monkeypatch.setattr(P, "CHUNK", 50)
    steps = P.gauss_transform(a, b, 0.7), P.exp_dist(a, b, s, s[:20])
    assert whole[0][0] == pytest.approx(steps[0][0]) and np.allclose(whole[0][1], steps[0][1]) and whole[1] == pytest.approx(steps[1])


def test_ncc_of_centred_rows_is_the_cosine():
    a = RNG.normal(size=(4, 30))
    a -= a.mean(1, keepdims=True)
    assert np.allclose(I.ncc_block(a, a), I.cosine_block(a, a)) and np.allclose(np.diag(I.ncc_block(a, a)), 1)


def test_rigid():
    assert np.allclose(P.rigid(np.array([[1.0, 0.0]]), 1, 2, np.pi / 2), [[1, 3]])
    pts = RNG.random((5, 2))
    back = P.rigid(pts - np.array([1, 2]), 0, 0, -0.5)
    assert np.allclose(P.rigid(back, 1, 2, 0.5), pts)


def test_cost_gradient_against_differences():
    a, b = RNG.random((13, 2)), RNG.random((11, 2))
    p = np.array([0.1, -0.2, 0.3])
    _, g = P.cost_and_gradient(a, b, p, 1.3)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert g[k] == pytest.approx((P.cost_and_gradient(a, b, p + e, 1.3)[0] - P.cost_and_gradient(a, b, p - e, 1.3)[0]) / 2e-6, abs=1e-7)


def test_exp_dist_against_loops():
    a, b, sa, sb = RNG.random((4, 2)), RNG.random((3, 2)), RNG.random(4) + 0.1, RNG.random(3) + 0.1
    want = sum(np.exp(-((a[i] - b[j]) ** 2).sum() / (sa[i] + sb[j])) for i in range(4) for j in range(3))
    assert P.exp_dist(a, b, sa, sb) == pytest.approx(want)


def test_register_finds_a_known_move():
    scene = np.stack([np.linspace(-2, 2, 25), 0.3 * np.linspace(-2, 2, 25) ** 2], 1)
    s = np.full(25, 0.05)
    score, tx, ty, theta = P.register(scene, P.rigid(scene, 0.4, -0.3, 0.5), s, s, scale=1.0, iterations=200)
    assert (tx, ty, theta) == pytest.approx((0.4, -0.3, 0.5), abs=1e-3)


def test_resample_prefers_dense_places():
    pts = np.concatenate([RNG.normal(0, 0.01, (80, 2)), RNG.random((20, 2)) * 10])
    kept = P.resample(pts, 2.0, 40, seed=1)
    assert len(kept) == 40 and (kept < 80).mean() > 0.8
    assert len(P.resample(pts[:5], 2.0, 40)) == 5


def test_linkage():
    s = np.array([[0, 9, 1, 0.0], [9, 0, 2, 0], [1, 2, 0, 5], [0, 0, 5, 0]])
    merges = C.linkage(s)
    assert merges[0] == (0, 1, 9.0, 2) and merges[1] == (2, 3, 5.0, 2) and merges[2][3] == 4 and merges[2][2] == pytest.approx((1 + 0 + 2 + 0) / 4)
    assert C.flat_clusters(4, merges, 3.0) == ([[0, 1], [2, 3]], [1, 1, 2, 2])
    assert C.linkage(-np.ones((3, 3))) == []
    assert C.flat_clusters(3, [], 0.5)[0] == [[0], [1], [2]]
    assert C.linkage(np.zeros((0, 0))) == []


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10**6))
def test_linkage_merges_by_mean_similarity(n, seed):
    r = np.random.default_rng(seed).random((n, n))
    s = (r + r.T) / 2
    np.fill_diagonal(s, 0)
    members = {k: [k] for k in range(n)}
    for step, (a, b, sim, size) in enumerate(C.linkage(s)):
        best = max(s[np.ix_(members[x], members[y])].mean() for x in members for y in members if x < y)
        assert sim == pytest.approx(best) and sim == pytest.approx(s[np.ix_(members[a], members[b])].mean())
        members[n + step] = members.pop(a) + members.pop(b)
        assert len(members[n + step]) == size


def test_linkage_reports_one_sum_over_the_number():
    """Six digits of a mean may hang on its last bit, so it is not carried from merge to merge."""
    r = np.round(np.random.default_rng(3).random((30, 30)), 6)
    s = np.triu(r, 1) + np.triu(r, 1).T
    members = {k: [k] for k in range(30)}
    for step, (a, b, sim, _) in enumerate(C.linkage(s)):
        x, y = members.pop(a), members.pop(b)
        total = 0.0  # sum() would compensate
        for i in x[::-1]:
            for j in y:
                total += s[i, j]
        assert sim == total / (len(x) * len(y))
        members[30 + step] = x + y


def test_rounding_is_that_of_sql():
    import duckdb

    a = np.array([0.5e-6, -0.5e-6, 1.5e-6, -1.5e-6, 0.4999999e-6, -1e-9, 0.0, -0.0, 1.0000005, -2.0000015, 0.1234565, 1e12, 3e15 + 0.5, -1e303, 1e308, np.inf, -np.inf, np.nan, 0.49999999999999994e-6])
    a = np.concatenate([a, np.arange(-2000, 2000) / 2**7 / 1e6 * 2**6, np.random.default_rng(0).standard_normal(5000)])
    want = duckdb.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS x)", [a.tolist()]).fetchnumpy()
    want = np.ma.filled(next(iter(want.values())), np.nan)
    got = I.rounded(a, 6)
    assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()
