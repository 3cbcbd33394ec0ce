"""Properties of the chip operators whose random choices SQL can't repeat."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from skyroute.operators import chips, overlay


def packed(spark, images):
    rows = [(stem, a.shape[1], a.shape[0], bytearray(a.tobytes())) for stem, a in images.items()]
    return spark.createDataFrame(rows, overlay.IMAGE)


def unpacked(df):
    return {r.stem: np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width, 3) for r in df.collect()}


def random_images(n, height, width, low=0, high=256):
    rng = np.random.default_rng(5)
    return {f"chip-{k}": rng.integers(low, high, (height, width, 3)).astype(np.uint8) for k in range(n)}


def test_batches_hold_every_example_once(spark):
    stems = [(f"s{k:04d}",) for k in range(330)]
    df = spark.createDataFrame(stems, "stem string")
    first, again, other = (chips.shuffled_batches(df, batch=64, seed=s).collect() for s in (1, 1, 2))
    assert sorted(r.stem for r in first) == [s for (s,) in stems]
    assert Counter(r.batch for r in first) == {0: 64, 1: 64, 2: 64, 3: 64, 4: 64, 5: 10}
    assert sorted(first) == sorted(again) != sorted(other)
    inside = [int(r.stem[1:]) for r in first if r.batch == 0]
    assert max(inside) > 250 and min(inside) < 80  # not a run of the sorted stems
    assert chips.shuffled_batches(df.limit(0)).count() == 0


def test_geometry_is_a_symmetry_of_the_square(spark):
    size, stems = 4, [f"s{k}" for k in range(40)]
    pixels = spark.createDataFrame([(s, x, y, 10 * y + x) for s in stems for y in range(size) for x in range(size)], "stem string, px int, py int, v int")
    square = np.array([[10 * y + x for x in range(size)] for y in range(size)])
    symmetries = {t.tobytes() for k in range(4) for t in (np.rot90(square, k).copy(), np.fliplr(np.rot90(square, k)).copy())}
    assert len(symmetries) == 8
    turned = defaultdict(lambda: np.full((size, size), -1, dtype=square.dtype))
    for r in chips.augment_geometry(pixels, size, 3, 11).collect():
        turned[r.stem, r.epoch][r.ay, r.ax] = r.v
    assert len(turned) == 3 * len(stems)
    found = Counter(a.tobytes() for a in turned.values())
    assert set(found) == symmetries


def test_bilinear_against_plain_loop(spark):
    images = random_images(3, 5, 7)
    for height, width in ((8, 3), (5, 7), (1, 1), (10, 14)):
        out = unpacked(overlay.resize_bilinear(packed(spark, images), width, height))
        assert out.keys() == images.keys()
        for stem, image in images.items():
            assert out[stem].shape == (height, width, 3)
            for i in range(height):
                for j in range(width):
                    y, x = min(max((i + 0.5) * 5 / height - 0.5, 0), 4), min(max((j + 0.5) * 7 / width - 0.5, 0), 6)
                    near = [(max(0, 1 - abs(y - a)) * max(0, 1 - abs(x - b)), image[a, b].astype(float)) for a in range(5) for b in range(7)]
                    value = sum(w * p for w, p in near)
                    assert np.abs(out[stem][i, j] - value).max() <= 0.5 + 1e-9
    assert overlay.resize_bilinear(packed(spark, {"a": images["chip-0"]}).limit(0), 2, 2).count() == 0


def test_colors_unchanged_without_ranges(spark):
    images = random_images(2, 3, 4)
    out = unpacked(overlay.augment_colors(packed(spark, images), 2, 3, brightness=0.0, hue=0.0, contrast=(1.0, 1.0)))
    assert sorted(out) == ["chip-0-0", "chip-0-1", "chip-1-0", "chip-1-1"]
    assert all((image == images[name[:-2]]).all() for name, image in out.items())


def test_colors_one_change_at_a_time(spark):
    images = random_images(4, 6, 6, 100, 156)
    df = packed(spark, images)
    shifts = set()
    for name, image in unpacked(overlay.augment_colors(df, 3, 3, brightness=0.3, hue=0.0, contrast=(1.0, 1.0))).items():
        moved = image.astype(int) - images[name[:-2]]
        assert moved.max() - moved.min() <= 1 and abs(moved).max() <= 0.3 * 255 + 1
        shifts.add(int(moved.max()))
    assert len(shifts) > 6  # anew for each image and epoch
    for name, image in unpacked(overlay.augment_colors(df, 1, 3, brightness=0.0, hue=0.0, contrast=(0.5, 0.5))).items():
        old = images[name[:-2]].astype(float)
        mean = old.mean(axis=(0, 1))
        assert np.abs(image - (mean + (old - mean) / 2)).max() <= 0.5 + 1e-6
    for name, image in unpacked(overlay.augment_colors(df, 2, 3, brightness=0.0, hue=0.1, contrast=(1.0, 1.0))).items():
        luma = [a.astype(float) @ [0.114, 0.587, 0.299] for a in (images[name[:-2]], image)]  # blue, green, red
        assert np.abs(luma[0] - luma[1]).max() <= 1.5
        assert (image != images[name[:-2]]).any()


def test_colors_repeat_with_the_seed(spark):
    df = packed(spark, random_images(2, 4, 4))
    one, same, other = (unpacked(overlay.augment_colors(df, 2, s)) for s in (1, 1, 2))
    assert all((one[k] == same[k]).all() for k in one) and any((one[k] != other[k]).any() for k in one)


@pytest.mark.parametrize("n", [1, 5])
def test_one_hot_sums_to_one(spark, n):
    rows = spark.range(n).select(chips.one_hot("id", n).alias("h")).collect()
    assert sorted(r.h for r in rows) == sorted([int(i == k) for i in range(n)] for k in range(n))
