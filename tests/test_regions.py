import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import regions as R
from maskwright.plans import pictures

SHAPE = "id long, width int, height int, pixels binary"


def slow_regions(g, covered):
    """Regions by loops over cells, a stack for connected ones, and steps of single columns."""
    h, w = g.shape
    rows, columns = -(-h // 8), -(-w // 8)
    on = set()
    for r in range(rows):
        for c in range(columns):
            part = g[8 * r : 8 * r + 8, 8 * c : 8 * c + 8]
            cx, cy = (8 * c + min(w, 8 * c + 8)) / 2, (8 * r + min(h, 8 * r + 8)) / 2
            if 28 <= part.mean() <= 150 and 1.2 <= part.std() <= 36 and not any(a <= cx <= x and b <= cy <= y for a, b, x, y in covered):
                on.add((r, c))
    on = {(r + i, c + j) for r, c in on for i in range(-2, 3) for j in range(-2, 3) if 0 <= r + i < rows and 0 <= c + j < columns}
    found, left = [], set(on)
    for start in sorted(on):
        if start not in left:
            continue
        stack, part = [start], []
        left.discard(start)
        while stack:
            r, c = stack.pop()
            part.append((r, c))
            for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        rs, cs = [p[0] for p in part], [p[1] for p in part]
        bw, bh = (max(cs) - min(cs) + 1) * 8, (max(rs) - min(rs) + 1) * 8
        if len(part) < 4 or bw < 36 or bh < 16 or bw * bh > w * h * 0.35:
            continue
        x, y = max(0, min(cs) * 8 - 28), max(0, min(rs) * 8 - 28)
        found.append(slow_grow(g, x, y, min(w, max(cs) * 8 + 36) - x, min(h, max(rs) * 8 + 36) - y))
    kept = []
    for r in sorted(found, key=lambda r: -r[2] * r[3]):
        for k in kept:
            ow, oh = (max(0, min(k[i] + k[i + 2], r[i] + r[i + 2]) - max(k[i], r[i])) for i in (0, 1))
            if abs(k[1] - r[1]) <= 15 and ow * oh / min(k[2] * k[3], r[2] * r[3]) > 0.6:
                break
        else:
            kept.append(r)
    return kept[:3]


def slow_grow(g, x, y, w, h):
    height, width = g.shape
    seen = sorted(v for v in g[y : y + h : 2, x : x + w : 2].ravel() if 28 <= v <= 170)
    if not seen:
        return x, y, w, h
    tone = seen[len(seen) // 2]

    def alike(c):
        column = [g[r, c] for r in range(y, min(height, y + h), 2)]
        return sum(abs(v - tone) <= 36 and 20 <= v <= 180 for v in column) / len(column) >= 0.5

    left, right = x, min(width, x + w) - 1
    while left > 0 and alike(left - 1):
        left -= 1
    while right < width - 1 and alike(right + 1):
        right += 1
    left, right, tall = max(0, left - 48), min(width - 1, right + 48), min(height, y + h) - y
    return (x, y, w, h) if (right - left + 1) * tall > width * height * 0.5 else (left, y, right - left + 1, tall)


def scene(seed):
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(40, 260)), int(rng.integers(60, 400))
    g = np.full((h, w), 230.0)
    for _ in range(int(rng.integers(0, 7))):
        x, y, bw, bh = int(rng.integers(0, w)), int(rng.integers(0, h)), int(rng.integers(10, 120)), int(rng.integers(6, 50))
        g[y : y + bh, x : x + bw] = rng.integers(20, 190) + rng.integers(-8, 9, g[y : y + bh, x : x + bw].shape)
    return np.clip(g + rng.integers(0, 3, g.shape), 0, 255).astype(np.uint8)


def test_regions_equal_loops(spark):
    scenes = [scene(k) for k in range(120)] + [pictures.drawn(k) for k in range(8)]
    covered = [(k, 0.0, 0.0, float(s.shape[1] // 2), float(s.shape[0])) for k, s in enumerate(scenes) if k % 3 == 0]
    df = spark.createDataFrame([(k, s.shape[1], s.shape[0], bytearray(s.tobytes())) for k, s in enumerate(scenes)], SHAPE)
    got = {}
    for r in R.find_regions(df, spark.createDataFrame(covered, "id long, x0 double, y0 double, x1 double, y1 double")).orderBy("id", "region").collect():
        got.setdefault(r.id, []).append((r.x, r.y, r.width, r.height))
    boxes = {k: [b] for k, *b in covered}
    want = {k: f for k, s in enumerate(scenes) if (f := slow_regions(s.astype(float), boxes.get(k, [])))}
    assert got == want and len(want) > 40 and max(map(len, want.values())) > 1


def slow_smooth(scores, radius):
    return [np.float32(np.mean([float(s) for s in scores[max(0, i - radius) : i + radius + 1]])) for i in range(len(scores))]


def slow_span(scores):
    smooth = slow_smooth(scores, 22)
    if max(smooth) < 12:
        return None
    peak = int(np.argmax(smooth))
    cut, start, end = float(smooth[peak]) * 0.16, peak, peak
    for step, stop in ((-1, -1), (1, len(scores))):
        dead = 0
        for i in range(peak + step, stop, step):
            if smooth[i] >= cut:
                start, end, dead = min(start, i), max(end, i), 0
            else:
                dead += 1
                if dead > 48:
                    break
    return max(0, start - 40), min(len(scores) - 1, end + 40)


def slow_band(scores):
    smooth = slow_smooth(scores, 3)
    if max(smooth) < 8:
        return None
    runs, run = [], []
    for i, v in enumerate([*smooth, -1]):
        if v >= max(smooth) * 0.45:
            run.append(i)
        elif run:
            runs.append((sum(float(smooth[k]) for k in run), -run[0], run[0], run[-1]))
            run = []
    return max(runs)[2:]


@pytest.mark.parametrize("seed", range(12))
def test_peaks_of_profiles_equal_loops(seed):
    rng = np.random.default_rng(seed)
    scores = (rng.integers(0, 60, 500) * (np.sin(np.arange(500) / rng.integers(5, 60)) > rng.uniform(-0.5, 0.95))).astype(np.float32)
    assert R.column_span(scores) == slow_span(scores) and R.strongest_band(scores, 8, 3) == slow_band(scores)
    assert R.column_span(scores * 0) is None and R.strongest_band(scores * 0, 8, 3) is None


def test_activity_and_row_scores_equal_loops():
    g = scene(5).astype(float)
    act = R.activity(g)
    for y in range(1, g.shape[0], 7):
        seen = [min(14, abs(g[y, x] - g[y, x - 1]) + abs(g[y, x] - g[y - 1, x])) for x in range(1, g.shape[1], 4)]
        assert act[y, 1::4].tolist() == seen and R.row_scores(g)[y] == sum(max(0, s - sorted(seen)[len(seen) // 2]) for s in seen)
    assert R.text_band(np.full((90, 90), 200.0)) == (0, 0, 90, 90) and R.text_band(g[:5, :5]) == (0, 0, 5, 5)
    line = np.full((120, 600), 200.0)
    line[50:60, 200:300:4] = 20
    rows = slow_band(R.row_scores(line))
    across = slow_span(R.column_scores(line, rows[0] - 8, rows[1] + 8))
    assert R.text_band(line) == (across[0], rows[0] - 8, across[1] - across[0] + 1, rows[1] - rows[0] + 17)
    assert 150 > across[0] > 130 and 40 <= rows[0] - 8 < 50 < rows[1]


def test_crops_scale_and_map_back(spark):
    g = scene(9)
    rgba = np.stack([g, g // 2, 255 - g, np.full_like(g, 7)], 2)
    df = spark.createDataFrame([(1, g.shape[1], g.shape[0], bytearray(g.tobytes())), (2, g.shape[1], g.shape[0], bytearray(rgba.tobytes())), (3, 5, 5, bytearray(b"x")), (None, 1, 1, bytearray(b"z"))], SHAPE)
    cut = spark.createDataFrame([(1, 0, 3.7, 2.2, 20.9, 9.0), (1, 1, -4.0, 0.0, 6.0, 1000.0), (2, 0, 1.0, 1.0, 4.0, 3.0), (3, 0, 0.0, 0.0, 2.0, 2.0), (None, 0, 0.0, 0.0, 1.0, 1.0), (1, 2, 5000.0, 0.0, 2.0, 2.0)], "id long, region int, x double, y double, width double, height double")
    rows = {(r.id, r.region): r for r in R.crops(df, cut, scale=2).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (3, None), (None, 0)} and rows[(3, None)].error
    first = rows[(1, 0)]
    assert (first.x, first.y, first.width, first.height) == (3, 2, 40, 18) and first.pixels == g[2:11, 3:23].repeat(2, 0).repeat(2, 1).tobytes()
    assert rows[(1, 1)].pixels == g[:, :6].repeat(2, 0).repeat(2, 1).tobytes() and rows[(2, 0)].pixels == rgba[1:4, 1:5].repeat(2, 0).repeat(2, 1).tobytes()
    opaque = {r.id: r for r in R.crops(df.where("id = 1"), cut.where("id = 1 and region = 0"), rgba=True).collect()}[1]
    assert opaque.pixels == np.stack([g[2:11, 3:23]] * 3 + [np.full((9, 20), 255)], 2).astype(np.uint8).tobytes()
    back = R.in_picture(R.crops(df, cut, scale=2).where("id = 1").selectExpr("*", "0.0d as x0", "0.0d as y0", "cast(width as double) as x1", "cast(height as double) as y1")).orderBy("region").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in back] == [(3, 2, 23, 11), (0, 0, 6, g.shape[0])]
    with pytest.raises(ValueError):
        R.crops(df, cut, scale=0)


def test_readings_of_regions(spark):
    texts = spark.createDataFrame([(1, 0, "no 10000000146 here"), (1, 1, "12 345 6789"), (None, 0, "word"), (2, 0, None)], "id long, region int, text string")
    rows = {(r.id, r.region): r.reading for r in R.second_readings(texts, ["id", "region"]).collect()}
    assert rows == {(1, 0): "valid-tckn", (1, 1): "CASE 2", (None, 0): "CASE 3", (2, 0): "CASE 3"}
    boxes = spark.createDataFrame([(1, 0, 10.6, 20.4, 30.0, 0.0)], "id long, region int, x double, y double, width double, height double")
    word = R.number_words(texts.where("id = 1 and region = 0").withColumn("text", F.lit("10000000146")), boxes, ["id"]).first()
    assert (word.x0, word.y0, word.x1, word.y1, word.line_id, word.line_index, word.confidence) == (10.6, 20.4, 40.6, 21.4, "p2-roi-y20-x11", 1020, 90.0)
    line = R.lines_of(R.number_words(texts.where("id = 1").withColumn("text", F.lit("10000000146")), boxes, ["id"])).first()
    assert line.id == line.line_id and len(line.words) == 1 and line.words[0].text == "10000000146"


def test_merging_takes_words_in_order(spark):
    shape = "page long, ordinal int, text string, x0 double, y0 double, x1 double, y1 double"
    first = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 30.0, 10.0), (None, 0, "n", 0.0, 0.0, 30.0, 10.0)], shape)
    second = [(1, 1, "near a", 5.0, 0.0, 35.0, 10.0), (1, 2, "b", 200.0, 0.0, 230.0, 10.0), (1, 3, "near b", 205.0, 0.0, 235.0, 10.0), (1, 4, "next", 222.0, 0.0, 252.0, 10.0), (1, 5, " ", 400.0, 0.0, 430.0, 10.0), (1, 6, "null box", None, 0.0, 1.0, 1.0), (1, 2, "b", 200.0, 0.0, 230.0, 10.0)]
    second += [(None, 1, "x", 3.0, 0.0, 33.0, 10.0), (1, 7, "10000000146", 600.0, 0.0, 700.0, 10.0), (1, 8, "10000000146", 610.0, 0.0, 710.0, 10.0), (1, 9, "10000000146", 602.0, 1.0, 702.0, 11.0)]
    got = R.merged_words(first, spark.createDataFrame(second, shape), ["page"])
    # The third near copy of b lies within reach of the second alone, which is gone: so it stays.
    assert sorted((r.page or 0, r.ordinal, r.text) for r in got.collect()) == [(0, 0, "n"), (1, 0, "a"), (1, 2, "b"), (1, 4, "next"), (1, 7, "10000000146"), (1, 9, "10000000146")]
