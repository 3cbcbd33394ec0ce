"""Chips: fixed windows cut out of images, their label pixels, and training sets made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The colours (blue, green, red) of the drone images' labels, of their background and of pixels to ignore.
LABEL_COLORS = {
    "building": (75, 25, 230), "clutter": (180, 30, 145), "vegetation": (75, 180, 60), "water": (48, 130, 245), "car": (200, 130, 0), "background": (255, 255, 255),
}
#: The colours of the orthophotos' labels and of their background.
ORTHO_COLORS = {"building": (28, 26, 227), "water": (170, 95, 30), "background": (0, 0, 0)}
IGNORE_COLOR = (255, 0, 255)


def _starts(length: Column, size: int, stride: int, include_last: bool) -> Column:
    """Chip origins along one side; the end is exclusive unless ``include_last``."""
    last = length - size - (0 if include_last else 1)
    return F.when(last >= 0, F.sequence(F.lit(0), F.when(last >= 0, last).otherwise(F.lit(0)).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def chip_grid(images: DataFrame, size: int, stride: int, *, include_last: bool = False) -> DataFrame:
    """(image_id, chip_no, x0, y0) for images (image_id, width, height), numbered column by column."""
    xs, ys = _starts(F.col("width"), size, stride, include_last), _starts(F.col("height"), size, stride, include_last)
    rows = images.select("image_id", F.size(ys).alias("per_column"), F.posexplode(xs).alias("i", "x0"), ys.alias("ys"))
    return rows.select("image_id", "per_column", "i", "x0", F.posexplode("ys").alias("j", "y0")).select(
        "image_id", (F.col("i") * F.col("per_column") + F.col("j")).alias("chip_no"), "x0", "y0"
    )


def chip_stem(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-%06d", prefix.cast("string"), number.cast("long"))


def pixels_to_chips(pixels: DataFrame, size: int, stride: int, width: int, height: int) -> DataFrame:
    """Pixels with the chip (x0, y0) of every window over them, and their place (cx, cy) in it; windows as in ``chip_grid``.

    A pixel computes its own windows, so nothing is joined or shuffled.
    """

    def origins(p: str, length: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(p) - size + 1) / stride))
        high = F.least(F.floor(F.col(p) / stride), F.lit((length - size - 1) // stride))
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k * stride).cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = pixels.withColumn("x0", F.explode(origins("px", width))).withColumn("y0", F.explode(origins("py", height)))
    return rows.withColumns({"cx": F.col("px") - F.col("x0"), "cy": F.col("py") - F.col("y0")})


def chunk_grid(sheets: DataFrame, nx: int = 12, ny: int = 8) -> DataFrame:
    """Chunks of sheets (sheet, width, height, left, top, unit): pixel box, name and box on the map; the remainder is dropped."""
    w, h = F.floor(F.col("width") / nx).cast("int"), F.floor(F.col("height") / ny).cast("int")
    rows = sheets.withColumns({"cw": w, "ch": h, "cx": F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))}).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    x0, y0 = F.col("cx") * F.col("cw"), F.col("cy") * F.col("ch")
    return rows.select(
        F.format_string("%s-%03d-%03d", F.col("sheet").cast("string"), "cx", "cy").alias("chunk"), x0.alias("px0"), y0.alias("py0"), (x0 + F.col("cw")).alias("px1"),
        (y0 + F.col("ch")).alias("py1"), (F.col("left") + x0 * F.col("unit")).alias("min_x"), (F.col("top") - (y0 + F.col("ch")) * F.col("unit")).alias("min_y"),
    )


def color_table(spark, colors: dict[str, tuple[int, int, int]] = LABEL_COLORS) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in colors.items()], "label string, b int, g int, r int")


def recode_colors(pixels: DataFrame, keep: list[str], colors: dict[str, tuple[int, int, int]] = LABEL_COLORS) -> DataFrame:
    """Pixels with ``label`` and ``category``: place in ``keep`` from 1, 0 for other labels; both null where the colour is unknown."""
    codes = F.broadcast(color_table(pixels.sparkSession, colors))  # as many rows as labels
    category = F.coalesce(*(F.when(F.col("label") == k, F.lit(i + 1)) for i, k in enumerate(keep)), F.when(F.col("label").isNotNull(), F.lit(0)))
    return pixels.join(codes, ["b", "g", "r"], "left").withColumn("category", category)


def unknown_colors(pixels: DataFrame, colors: dict[str, tuple[int, int, int]] = LABEL_COLORS) -> DataFrame:
    """(b, g, r, pixels) of colours that are in no label."""
    counts = pixels.groupBy("b", "g", "r").agg(F.count("*").alias("pixels"))
    return counts.join(F.broadcast(color_table(pixels.sparkSession, colors)), ["b", "g", "r"], "left_anti")


def drop_ignored_chips(pixels: DataFrame, chip: list[str], color: tuple[int, int, int] = IGNORE_COLOR) -> DataFrame:
    """Pixels of chips without a single pixel of the colour to ignore."""
    bad = pixels.where(" and ".join(f"{n} = {v}" for n, v in zip("bgr", color, strict=True))).select(*chip).distinct()
    return pixels.join(bad, chip, "left_anti")


def label_pixel_counts(pixels: DataFrame, chip: list[str]) -> DataFrame:
    """(chip, label, pixels) of recoded pixels; background and labels that aren't kept have no row."""
    return pixels.where("category > 0").groupBy(*chip, "label").agg(F.count("*").alias("pixels"))


def merge_chip_sets(sets: list[DataFrame], required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, repeated stems) of chip sets (dataset, stem, labels, size, stride), which must agree in size and stride."""
    both = sets[0]
    for more in sets[1:]:
        both = both.unionByName(more)
    shapes = both.select("size", "stride").distinct().limit(2).count()
    if shapes > 1:
        raise ValueError("chip sets differ in size or stride")
    repeated = both.groupBy("stem").agg(F.count("*").alias("sets")).where("sets > 1")
    kept = both.where(F.forall(F.array(*map(F.lit, required)), lambda k: F.map_contains_key("labels", k))) if required else both
    return kept, repeated


def has_classes(labels: str, classes: list[str], mode: str = "any") -> Column:
    """Whether a label map has any, or all, of the classes."""
    test = F.exists if mode == "any" else F.forall
    return test(F.array(*map(F.lit, classes)), lambda k: F.map_contains_key(labels, k))


def category_to_color(pixels: DataFrame, classes: list[str], colors: dict[str, tuple[int, int, int]] = LABEL_COLORS, background: tuple[int, int, int] = (0, 0, 0), offset: int = 1) -> DataFrame:
    """Pixels with b, g, r of their category; class k has the category k + offset, and other categories the background."""
    codes = {k + offset: colors[c] for k, c in enumerate(classes)}

    def channel(n: int) -> Column:
        return F.coalesce(*(F.when(F.col("category") == k, F.lit(v[n])) for k, v in codes.items()), F.lit(background[n]))

    return pixels.withColumns({"b": channel(0), "g": channel(1), "r": channel(2)})


def one_hot(category: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(category)).cast("int"))


def coco_annotations(polygons: DataFrame) -> DataFrame:
    """(id, area, polygon_id, segmentation, area_px, bbox, iscrowd) of polygons: outer ring, area without holes, box.

    Ids run from 1 in order of area and polygon_id, which together are distinct.
    """
    from skyroute.functions import geometry as G

    outer = F.element_at("rings", 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    size = F.aggregate(F.transform("rings", lambda r, k: F.abs(G.signed_area(r)) * F.when(k == 0, 1).otherwise(-1)), F.lit(0.0), lambda a, v: a + v)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    rows = polygons.select(
        "area", "polygon_id", F.flatten(F.transform(outer, lambda p: F.array(p["x"], p["y"]))).alias("segmentation"), size.alias("area_px"), box.alias("bbox"), F.lit(0).alias("iscrowd")
    )
    return global_rank(rows, [F.col("area"), F.col("polygon_id")], "id")


def coco_categories(spark, labels: list[str]) -> DataFrame:
    """(id, name): the labels with ids by their place in the list, from 0."""
    return spark.createDataFrame(list(enumerate(labels)), "id int, name string")


def resize_nearest(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Masks (image_id, px, py, …) at another size: each new pixel (px, py) is the old one under its upper left corner.

    Each old pixel lists the new ones that it gives, so nothing is joined.
    """

    def targets(p: str, old: int, new: int) -> Column:
        low, high = F.ceil(F.col(p) * new / old), F.ceil((F.col(p) + 1) * new / old) - 1
        return F.when(low <= high, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))

    return pixels.withColumns({"nx": targets("px", width, to_width), "ny": targets("py", height, to_height)}).withColumn("px", F.explode("nx")).withColumn("py", F.explode("ny")).drop("nx", "ny")


def augment_geometry(pixels: DataFrame, size: int, epochs: int, seed: int, stem: str = "stem") -> DataFrame:
    """Pixels of square chips turned and flipped, anew for each epoch, the same for all pixels of a chip.

    A hash of stem, epoch and seed gives the quarter turns (0 to 3) and the two flips.
    """
    rows = pixels.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h = F.pmod(F.xxhash64(stem, "epoch", F.lit(seed)), F.lit(16)).cast("int")
    rows = rows.withColumns({"turns": F.pmod(h, F.lit(4)), "flip_x": h.bitwiseAND(F.lit(4)) > 0, "flip_y": h.bitwiseAND(F.lit(8)) > 0})
    m = size - 1
    x = F.when(F.col("turns") == 0, F.col("px")).when(F.col("turns") == 1, F.col("py")).when(F.col("turns") == 2, m - F.col("px")).otherwise(m - F.col("py"))
    y = F.when(F.col("turns") == 0, F.col("py")).when(F.col("turns") == 1, m - F.col("px")).when(F.col("turns") == 2, m - F.col("py")).otherwise(F.col("px"))
    return rows.withColumns({"ax": F.when(F.col("flip_x"), m - x).otherwise(x), "ay": F.when(F.col("flip_y"), m - y).otherwise(y)})


# ----------------------------------------------------------------------------------------------- training sets


def class_pixel_totals(chips: DataFrame, classes: list[str], chip_pixels: int, mode: str = "any") -> DataFrame:
    """(label, pixels) over the chips (stem, labels) that have the classes; the background is what no label covers."""
    fit = chips.where(has_classes("labels", classes, mode))
    labelled = F.aggregate(F.map_values("labels"), F.lit(0).cast("long"), lambda a, v: a + v)
    per_label = fit.select(F.explode("labels").alias("label", "pixels"))
    background = fit.select(F.lit("background").alias("label"), (F.lit(chip_pixels) - labelled).alias("pixels"))
    return per_label.union(background).groupBy("label").agg(F.sum("pixels").cast("long").alias("pixels"))


def class_weights(totals: DataFrame) -> DataFrame:
    """(label, weight): inverse to the pixels and summing up to 1; a label without pixels has the weight 0."""
    inverse = F.when(F.col("pixels") > 0, 1.0 / F.col("pixels")).otherwise(0.0)
    rows = totals.select("label", inverse.alias("w"))
    return rows.select("label", (F.col("w") / rows.agg(F.sum("w")).scalar()).alias("weight"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in a total order, without one window over all rows.

    Rows are range-partitioned and sorted, numbered within a partition, and moved by the counts of the partitions before.
    The order must be total; the table is read twice.
    """
    from skyroute.sources.staging import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")


def split(examples: DataFrame, train: float = 0.75, validation: float = 0.24, key: str = "stem") -> DataFrame:
    """Examples with ``split``: the first int(n train) in order are training, up to int(n (train + validation)) validation, the rest test."""
    ranked = global_rank(examples, [F.col(key)], "_place")
    n = examples.count()
    cut_a, cut_b = int(n * train), int(n * (train + validation))
    return ranked.withColumn("split", F.when(F.col("_place") <= cut_a, "train").when(F.col("_place") <= cut_b, "validation").otherwise("test")).drop("_place")


def shuffled_batches(examples: DataFrame, batch: int = 64, seed: int = 0, key: str = "stem") -> DataFrame:
    """Examples with ``batch``: fixed-size batches of a random order."""
    ranked = global_rank(examples.withColumn("_h", F.xxhash64(key, F.lit(seed))), [F.col("_h"), F.col(key)], "_place")
    return ranked.withColumn("batch", F.floor((F.col("_place") - 1) / batch)).drop("_place", "_h")


def chip_inventory(chips: DataFrame) -> DataFrame:
    """Chips per dataset and sheet, with totals (level 1 per dataset, 3 in all)."""
    return chips.rollup("dataset", "sheet").agg(F.count("*").alias("chips"), F.grouping_id().cast("int").alias("level"))


def shot_keyframes(frames: DataFrame, threshold: float, bins: int = 4) -> DataFrame:
    """(video, shot, first, last, keyframe): shots end where the mean chi-square distance of block histograms exceeds the threshold.

    Frames are (video, frame, histogram) with the blocks' histograms of ``bins`` values on end; the keyframe is the middle one.
    """
    order = Window.partitionBy("video").orderBy("frame")
    terms = F.zip_with("histogram", "before", lambda a, b: F.when(a + b > 0, (a - b) * (a - b) / F.nullif(a + b, F.lit(0.0))).otherwise(0.0))
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    rows = frames.withColumn("before", F.lag("histogram").over(order))
    rows = rows.withColumn("cut", F.when(F.col("before").isNotNull() & (total / (F.size("histogram") / bins) > threshold), 1).otherwise(0))
    rows = rows.withColumn("shot", F.sum("cut").over(order))
    place = Window.partitionBy("video", "shot")
    rows = rows.withColumns({"i": F.row_number().over(place.orderBy("frame")), "n": F.count("*").over(place)})
    return rows.groupBy("video", "shot").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.max(F.when(F.col("i") == F.floor((F.col("n") + 1) / 2), F.col("frame"))).alias("keyframe")
    )
