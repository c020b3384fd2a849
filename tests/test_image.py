import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import image as I


def gray(seed=0, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.float64)


def test_local_moments_match_a_loop():
    g = gray(h=12, w=15)
    mean, sd = I.local_moments(g, 5)
    for y in range(12):
        for x in range(15):
            part = g[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
            assert abs(mean[y, x] - part.mean()) < 1e-9 and abs(sd[y, x] - part.std()) < 1e-6


def test_threshold_and_shape():
    g = np.full((30, 30), 200.0)
    g[10:14, 5:25] = 20
    out = I.VARIANTS["adaptive"](g)
    assert set(np.unique(out)) <= {0.0, 255.0} and 0 < (out == 0).mean() < 1
    assert I.upscale(g).shape == (90, 90) and I.pixelate(g, 7).shape == g.shape
    assert (I.prefer_dark_glyphs(g) == 255 - g).all() and (I.prefer_dark_glyphs(255 - g) == 255 - g).all()
    assert I.stretch(gray()).min() == 0 and I.stretch(gray()).max() == 255


@pytest.mark.parametrize("variant", sorted(I.VARIANTS))
def test_prepare_isolates_bad_images(spark, variant):
    good = gray(3).astype(np.uint8)
    df = spark.createDataFrame([(1, 60, 40, bytearray(good.tobytes())), (2, 60, 40, bytearray(b"xx")), (3, 60, 40, None)], "id long, width int, height int, pixels binary")
    rows = {r.id: r for r in I.prepare(df, variant).collect()}
    want = np.rint(I.VARIANTS[variant](good.astype(np.float64))).astype(np.uint8)
    assert rows[1].pixels == want.tobytes() and (rows[1].height, rows[1].width) == want.shape
    assert rows[2].error and rows[3].error and rows[2].pixels is None


def test_burned_pixels_are_black(spark):
    good = gray(4).astype(np.uint8)
    df = spark.createDataFrame([(1, 60, 40, bytearray(good.tobytes())), (2, 60, 40, bytearray(good.tobytes()))], "id long, width int, height int, pixels binary")
    boxes = spark.createDataFrame([(1, 5.5, 3.2, 10.0, 4.0), (1, 50.0, 35.0, 100.0, 100.0), (1, 0.0, 0.0, 0.0, 5.0)], "id long, x double, y double, w double, h double")
    rows = {r.id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(40, 60) for r in I.burn(df, boxes).collect()}
    assert (rows[1][3:8, 5:16] == 0).all() and (rows[1][35:, 50:] == 0).all() and (rows[1][20, :50] == good[20, :50]).all()
    assert (rows[2] == good).all()


def test_stats_match_numpy(spark):
    g = gray(5, 4, 6)
    df = spark.createDataFrame([(1, [int(v) for v in g.ravel()]), (2, [])], "id int, p array<int>").select("id", I.gray_stats(F.col("p")).alias("s"))
    rows = {r.id: r.s for r in df.collect()}
    assert rows[2] is None
    assert (rows[1]["min"], rows[1]["max"]) == (g.min(), g.max()) and abs(rows[1]["sd"] - g.std()) < 1e-9 and rows[1]["foreground"] == (g < 128).mean()


def test_coarse_grid_and_box_blur_match_loops():
    g = gray(6, 13, 17)
    small = I.shrunk(g, 13, 17)
    assert np.abs(small - g).max() < 1e-9 and abs(I.shrunk(g, 5, 4).mean() - g.mean()) < 1e-9
    fine = g.repeat(4, 0).repeat(5, 1)
    assert np.abs(I.shrunk(g, 4, 5) - fine.reshape(4, 13, 5, 17).mean((1, 3))).max() < 1e-9
    blurred = I.box_blur(g, 2)
    wide = np.pad(g, 2, mode="edge")
    for y in range(13):
        for x in range(17):
            assert abs(blurred[y, x] - wide[y : y + 5, x : x + 5].mean()) < 1e-9
    assert np.abs(I.stretched(np.full((3, 2), 7.0), 30, 40) - 7).max() < 1e-12


@pytest.mark.parametrize("strength", [1, 10, 30, 50])
def test_blur_keeps_tone_and_loses_letters(strength):
    g = np.full((40, 120), 230.0)
    g[10:30, 20:100:6] = 20
    g[10:30, 21:100:6] = 20
    out = I.stable_blur(g, strength)
    assert out.shape == g.shape and abs(out.mean() - g.mean()) < 25
    inner = out[15:25, 40:80]
    assert np.abs(np.diff(inner, axis=1)).max() < 6 < np.abs(np.diff(g[15:25, 40:80], axis=1)).max()
    # Regions of one row or column too, and nothing outside counts.
    assert I.stable_blur(g[:1, :1], strength).shape == (1, 1) and (I.stable_blur(g[5:35, 10:50].copy(), strength) == I.stable_blur(g[5:35, 10:50], strength)).all()


def test_styles_are_burnt_and_tiles_equal_the_whole(spark):
    g = gray(7, 60, 90).astype(np.uint8)
    shape = "id long, width int, height int, pixels binary"
    boxes = [(1, 4.0, 4.0, 20.0, 12.0, "blur", 20.0), (1, 40.0, 10.0, 17.0, 9.0, "pixelate", 4.0), (1, 50.0, 10.0, 30.0, 30.0, "blackout", None), (1, 0.0, 50.0, 10.0, 20.0, None, None)]
    kinds = "id long, x double, y double, w double, h double, style string, strength double"
    whole = np.frombuffer(bytes(I.burn(spark.createDataFrame([(1, 90, 60, bytearray(g.tobytes()))], shape), spark.createDataFrame(boxes, kinds)).first().pixels), np.uint8).reshape(60, 90)
    assert (whole[10:40, 50:80] == 0).all() and (whole[50:, :10] == 0).all() and (whole[45:, 20:] == g[45:, 20:]).all()
    assert (whole[10:19, 40:50] == I.pixelate(g[10:19, 40:57], 4)[:, :10]).all() and (whole[4:16, 4:24] == np.rint(I.stable_blur(g[4:16, 4:24], 20.0))).all()
    # The same rectangles over tiles that hold them whole give the same pixels.
    left = spark.createDataFrame([(1, 30, 60, bytearray(g[:, :30].tobytes()))], shape)
    part = np.frombuffer(bytes(I.burn(left, spark.createDataFrame(boxes[:1] + boxes[3:], kinds)).first().pixels), np.uint8).reshape(60, 30)
    assert (part == whole[:, :30]).all()
