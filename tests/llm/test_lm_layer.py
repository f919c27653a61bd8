"""The language model's layer against a plain computation in double precision."""

import numpy as np
from strandlake.llm import lm_score as L


def _plain(p, c, targets):
    """Log chances of the targets, a window and a place at a time."""
    out = np.zeros(targets.shape)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for i, j in zip(*np.nonzero(targets >= 0), strict=True):
        x = p["e"][c[i, : j + 1]] + p["pos"][: j + 1]
        a = np.exp(soft((x @ p["k"]) @ (x[-1] @ p["q"]) / L.WIDTH**0.5))
        h = x[-1] + a @ (x @ p["v"])
        g, t = divmod(int(targets[i, j]), L.GROUP)
        out[i, j] = soft(h @ p["u"] + p["b"])[g] + soft(h @ p["w"][g] + p["c"][g])[t]
    return out


def _some(scale=1.0):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 400) * 13 % L.OWN_IDS
    c, targets, _, _ = L.id_windows(ids, np.array([0, 5, 150, 151, 400]))
    layer = L.Layer.new(np.bincount(ids, minlength=L.OWN_IDS))
    for n in ("q", "u", "w"):
        layer.p[n] *= np.float32(scale)
    return layer, c, targets


def test_places_without_targets_are_keys_only():
    layer, c, targets = _some()
    whole, late = layer.forward(c)["h"], layer.forward(c, L.OVERLAP)["h"]
    assert late.shape == (len(c), L.WINDOW - L.OVERLAP, L.WIDTH)
    assert np.allclose(whole[:, L.OVERLAP :], late, atol=1e-5)
    want = _plain({n: x.astype(float) for n, x in layer.p.items()}, c, targets)
    assert np.abs(layer.log_chance(c, targets) - want).max() < 1e-3


def test_large_logits():
    layer, c, targets = _some(60.0)
    want = _plain({n: x.astype(float) for n, x in layer.p.items()}, c, targets)
    found = layer.log_chance(c, targets)
    assert np.isfinite(found).all()
    assert np.abs(found - want).max() < 1e-2 * np.abs(want).max()
    assert np.isfinite(layer.train_step(c, targets, {}, 1, 0.003))


def test_gradient():
    """A first step moves each weight against the slope of the loss, for all weights with a clear slope."""
    layer, c, targets = _some()
    p, real = {n: x.astype(float) for n, x in layer.p.items()}, (targets >= 0).sum()
    state = {}
    loss = layer.train_step(c, targets, state, 1, 1e-4)
    assert abs(loss + _plain(p, c, targets).sum() / real) < 1e-3
    rng = np.random.default_rng(5)
    for n in p:
        slope = state[n][0].ravel() * 10
        at = rng.choice(np.argsort(-np.abs(slope))[:20], 2, replace=False)
        for k in at:
            low, high = ({m: x.copy() for m, x in p.items()} for _ in range(2))
            low[n].ravel()[k] -= 1e-4
            high[n].ravel()[k] += 1e-4
            want = (_plain(low, c, targets).sum() - _plain(high, c, targets).sum()) / real / 2e-4
            assert abs(slope[k] - want) < 0.02 * abs(want) + 1e-5, (n, k)
