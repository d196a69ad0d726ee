import numpy as np
import pytest

from pageforge.operators import images


def page(tilt=0.0, size=400):
    """A white page with a dark box, turned."""
    a = np.full((size, size, 3), 255, np.uint8)
    a[150:250, 80:320] = 0
    return images.rotate(a, tilt)


@pytest.mark.parametrize("tilt", [0.0, 3.0, -4.5, 10.0])
def test_skew_is_found_and_mended(tilt):
    g = images.gray(page(tilt))
    found = images.skew(g)
    assert abs(found + tilt) < 0.6
    mended = images.rotate(page(tilt), found)
    assert abs(images.skew(images.gray(mended))) < 0.6


def test_few_and_steep():
    assert images.skew(np.full((50, 50), 255, np.uint8)) == 0 and images.skew(images.gray(page(20.0))) == 0


def test_rotate_quarter_keeps_box():
    a = np.zeros((41, 41), np.uint8)
    a[10, 20] = 255
    assert images.rotate(a, 90)[20, 10] == 255 and images.rotate(a, 0.04) is a


def test_filters():
    a = np.full((20, 20), 100, np.uint8)
    a[5, 5] = 255
    assert (images.median3(a) == 100).all()
    assert images.sharpen(a)[5, 5] == 255 and images.sharpen(a)[5, 6] == 0 and images.sharpen(a)[15, 15] == 100
    assert images.edge_level(a) == pytest.approx(4 * 155 / 380)
    assert images.edge_level(a[:1]) == 0 and images.edge_level(a[5:6, 3:7]) == pytest.approx(155 * 2 / 3)
    assert images.gray(np.full((2, 2, 3), (10, 20, 30), np.uint8))[0, 0] == 18


def test_threshold_and_equalize():
    ramp = np.tile(np.arange(256, dtype=np.uint8), (64, 1))
    assert (images.threshold(ramp) == 255).all()
    dot = ramp.copy()
    dot[30:33, 200:203] = 0
    assert (images.threshold(dot)[31, 200:203] == 0).all()
    low = (ramp // 8 + 100).astype(np.uint8)
    spread = images.equalize(low)
    assert spread.shape == low.shape and np.ptp(spread.astype(int)) > np.ptp(low.astype(int))
    assert images.equalize(np.full((13, 17), 7, np.uint8)).shape == (13, 17)


def test_sizes():
    a = np.full((100, 333, 3), 9, np.uint8)
    assert images.resize(a, 1.25).shape == (125, 416, 3) and (images.resize(a, 1.6) == 9).all()
    big = np.full((30, 3201), 200, np.uint8)
    assert images.fit(big).shape == (14, 1600) and (images.fit(big) == 200).all() and images.fit(a) is a


@pytest.mark.parametrize("preset, value, want, shape", [("AUTO", 50, "low_light", 170), ("auto", 200, "clean_doc", 150), ("photo", 200, "photo", 160), ("Low_Light ", 200, "low_light", 170), ("odd", 200, "clean_doc", 150)])
def test_presets(preset, value, want, shape):
    out, used = images.prepare(np.full((100, 100, 3), value, np.uint8), preset)
    assert used == want and out.shape == (shape, shape, 3)


def test_strong_contrast_is_photo():
    a = np.full((40, 40, 3), 255, np.uint8)
    a[:, :20] = 30
    assert images.preset_of(a, "auto") == "photo"
