"""Kernels on hand-made pictures."""

import hashlib

import numpy as np
import pytest

from sparkweave.functions import pixels as P


def leaf(side=48):
    x = np.full((side, side, 3), 245, np.uint8)
    x[8:40, 18:30] = (40, 140, 50)
    return x


def test_foreground_finds_the_leaf():
    x = leaf()
    want = np.zeros((48, 48), bool)
    want[8:40, 18:30] = True
    assert (P.foreground_otsu(x) == want).all() and (P.foreground_clusters(x) == want).all()
    assert (P.on_white(x, want)[0, 0] == 255).all()


def test_components_and_largest():
    m = np.zeros((6, 9), bool)
    m[0, :2], m[3:, 4:] = True, True
    assert len(np.unique(P.components(m))) == 3
    assert P.largest(m).sum() == 15
    assert not P.largest(np.zeros((3, 3), bool)).any()


@pytest.mark.parametrize("turn", [-30, -10, 0, 15, 40])
def test_angle_of_a_turned_leaf(turn):
    turned = P.rotate(leaf(64), turn)
    found = P.angle(P.grey(turned) < 200)
    assert abs(abs(found) - abs(turn)) < 4
    if turn:
        assert abs(P.angle(P.grey(P.rotate(turned, found)) < 200)) < 4


def test_upright_straightens():
    turned = P.rotate(leaf(64), 25)
    assert abs(P.voted_angle(P.foreground(P.upright(turned))[1])) < abs(P.voted_angle(P.foreground(turned)[1]))


def test_hsv_there_and_back():
    x = np.random.default_rng(1).integers(0, 256, (20, 20, 3), dtype=np.uint8)
    assert np.abs(P.from_hsv(P.hsv(x)).astype(int) - x).max() <= 1


def test_corrections_do_what_they_say():
    rng = np.random.default_rng(2)
    x = np.clip(leaf().astype(float) + rng.normal(0, 12, (48, 48, 3)), 0, 255).astype(np.uint8)
    assert P.quality(P.denoise(x, 25.0))["noise"] < P.quality(x)["noise"]
    assert P.quality(P.sharpen(x, 2.0))["blur"] > P.quality(x)["blur"]
    assert P.quality(P.contrast(leaf(), 0.5))["contrast"] < P.quality(leaf())["contrast"]
    cast = np.clip(x * np.array([1.0, 0.6, 0.6]), 0, 255).astype(np.uint8)
    assert P.quality(P.gray_world(cast))["cast"] < P.quality(cast)["cast"]
    dim = (x // 4).astype(np.uint8)
    assert P.quality(P.stretch(dim))["contrast"] > P.quality(dim)["contrast"]
    assert P.brightness_factor(0) == 1 and P.brightness_factor(10) == 2 and P.brightness_factor(250) == pytest.approx(0.512)


def test_edges_and_shape():
    x = leaf()
    found = P.edges(P.grey(x))
    assert 0 < found.sum() < 300 and not found[20:28, 22:26].any()
    s = P.shape(x, P.foreground_otsu(x))
    assert s["aspect"] == pytest.approx(32 / 12)


def test_resize_keeps_flat_pictures_and_hashes_keep_likeness():
    flat = np.full((10, 30, 3), 77, np.uint8)
    assert (P.resize(flat, 64, 7) == 77).all()
    assert P.resize_within(flat, 15).shape == (5, 15, 3) and P.resize_within(flat, 99) is flat
    apart = lambda a, b: bin((P.perceptual_hash(a) ^ P.perceptual_hash(b)) & (2**64 - 1)).count("1")
    x = P.to_bytes(P.blur(np.random.default_rng(3).uniform(0, 255, (64, 64, 3)), 6) * 4 - 380)
    assert apart(x, P.resize(x, 96, 96)) < 6 < apart(x, x[::-1])


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (2, 3), (5, 5), (33, 17)])
def test_every_kernel_takes_every_size(shape):
    x = np.random.default_rng(4).integers(0, 256, (*shape, 3), dtype=np.uint8)
    for name, step in P.STEPS.items():
        assert step(x).shape == x.shape and step(x).dtype == np.uint8, name
    for name, f in P.AUGMENT.items():
        out = f(x, np.random.default_rng(5))
        assert out.shape == x.shape and out.dtype == np.uint8, name
    P.quality(x), P.asset_metrics(x), P.shape(x, P.foreground(x)[1]), P.perceptual_hash(x), P.thumbnail_hash(x)
    assert P.tensor(x).shape == (3, 224, 224) and len(P.project(x, 8)) == 8
    assert P.mixup(x, x, 0.3).shape == P.cutmix(x, x, 0.7, np.random.default_rng(6)).shape == x.shape


def test_thumbnail_hash_tells_pixels_apart():
    x = leaf()
    y = x.copy()
    y[24, 24] = 0
    flat = [np.full((n, n, 3), 9, np.uint8) for n in (5, 64, 90)]
    assert P.thumbnail_hash(x) == P.thumbnail_hash(x.copy()) != P.thumbnail_hash(y)
    assert {P.thumbnail_hash(f) for f in flat} == {hashlib.sha256(bytes([9]) * 64 * 64 * 3).hexdigest()}


def test_mixes():
    a, b = np.zeros((10, 10, 3), np.uint8), np.full((10, 10, 3), 200, np.uint8)
    assert (P.mixup(a, b, 0.25) == 150).all()
    assert (P.cutmix(a, b, 0.75, np.random.default_rng(7)) == 200).all(-1).sum() == 25
