"""Queries of the chip, training-set, evaluation and design operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyroute.jobs import oracles as O
from skyroute.jobs import world
from skyroute.operators import chips, design, evaluate
from skyroute.operators.vertices import normalize_winding

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Area of a chip whose labels come from documents, its classes, and chips cut from images of 100 x 100 pixels.
CHIP_PIXELS, CLASSES = 90_000, ["building", "water"]
SIDE = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _images(spark, sf):
    return world.pixels(spark, sf).select("image_id").distinct().select("image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


@query(f"""WITH {O.PIXELS}, im AS (SELECT DISTINCT image_id FROM pixels)
  SELECT image_id, CAST(i * 4 + j AS INTEGER) chip_no, CAST(i * 20 AS INTEGER) x0, CAST(j * 20 AS INTEGER) y0, image_id || '-' || lpad(CAST(i * 4 + j AS VARCHAR), 6, '0') stem
  FROM im, range(4) a(i), range(4) b(j)""")
def chip_grid(spark, sf):
    """Overlapping chips of 30 pixels every 20: four by four, since the last full chip is left out."""
    return chips.chip_grid(_images(spark, sf), 30, 20).withColumn("stem", chips.chip_stem(F.col("image_id"), F.col("chip_no")))


@query(f"""WITH {O.PIXELS}, cut AS (SELECT image_id, i * 20 x0, j * 20 y0 FROM (SELECT DISTINCT image_id FROM pixels), range(4) a(i), range(4) b(j))
  SELECT c.image_id, CAST(x0 AS INTEGER) x0, CAST(y0 AS INTEGER) y0, count(*) pixels, CAST(sum(px - x0) AS BIGINT) sum_cx, CAST(sum(py - y0) AS BIGINT) sum_cy
  FROM cut c JOIN pixels p ON c.image_id = p.image_id AND px >= x0 AND px < x0 + 30 AND py >= y0 AND py < y0 + 30 GROUP BY ALL""")
def pixels_to_chips(spark, sf):
    """Pixels of each overlapping chip, counted."""
    cut = chips.pixels_to_chips(world.pixels(spark, sf), 30, 20, SIDE, SIDE)
    return cut.groupBy("image_id", "x0", "y0").agg(F.count("*").alias("pixels"), F.sum("cx").alias("sum_cx"), F.sum("cy").alias("sum_cy"))


_CUT25 = f"""{O.PIXELS}, cut AS (SELECT *, px // 25 * 25 x0, py // 25 * 25 y0 FROM pixels WHERE px < 75 AND py < 75)"""


def _cut25(spark, sf):
    return chips.pixels_to_chips(world.pixels(spark, sf), 25, 25, SIDE, SIDE)


_CHIP = ["image_id", "x0", "y0"]


@query("""WITH s AS (SELECT p_partkey sheet, p_partkey % 500 + 97 w, p_partkey % 300 + 61 h FROM part)
  SELECT sheet || '-' || lpad(CAST(i AS VARCHAR), 3, '0') || '-' || lpad(CAST(j AS VARCHAR), 3, '0') chunk, CAST(i * (w // 12) AS INTEGER) px0, CAST(j * (h // 8) AS INTEGER) py0,
  CAST((i + 1) * (w // 12) AS INTEGER) px1, CAST((j + 1) * (h // 8) AS INTEGER) py1, sheet * 1000 + i * (w // 12) * CAST(0.25 AS DOUBLE) min_x,
  50000 - (j + 1) * (h // 8) * CAST(0.25 AS DOUBLE) min_y FROM s, range(12) a(i), range(8) b(j)""")
def chunk_grid(spark, sf):
    sheets = world.table(spark, sf, "part").selectExpr(
        "p_partkey sheet", "int(p_partkey % 500 + 97) width", "int(p_partkey % 300 + 61) height", "p_partkey * 1000D left", "50000D top", "0.25D unit"
    )
    return chips.chunk_grid(sheets)


@query(f"""WITH {O.PIXELS} SELECT image_id, px, py, CASE WHEN colour = 'ignore' THEN NULL ELSE colour END AS label,
  CAST(CASE colour WHEN 'building' THEN 1 WHEN 'water' THEN 2 WHEN 'ignore' THEN NULL ELSE 0 END AS INTEGER) category FROM pixels""")
def recode_colors(spark, sf):
    return chips.recode_colors(world.pixels(spark, sf), CLASSES).select("image_id", "px", "py", "label", "category")


@query(f"WITH {O.PIXELS} SELECT CAST(255 AS INTEGER) b, CAST(0 AS INTEGER) g, CAST(255 AS INTEGER) r, count(*) pixels FROM pixels WHERE colour = 'ignore' HAVING count(*) > 0")
def recode_colors__unknown(spark, sf):
    return chips.unknown_colors(world.pixels(spark, sf))


@query(f"""WITH {_CUT25} SELECT image_id, px, py, CAST(x0 AS INTEGER) x0, CAST(y0 AS INTEGER) y0 FROM cut
  WHERE (image_id, x0, y0) NOT IN (SELECT (image_id, x0, y0) FROM cut WHERE colour = 'ignore')""")
def drop_ignored_chips(spark, sf):
    return chips.drop_ignored_chips(_cut25(spark, sf), _CHIP).select("image_id", "px", "py", "x0", "y0")


@query(f"""WITH {_CUT25} SELECT image_id, CAST(x0 AS INTEGER) x0, CAST(y0 AS INTEGER) y0, colour AS label, count(*) pixels FROM cut WHERE colour IN ('building', 'water')
  AND (image_id, x0, y0) NOT IN (SELECT (image_id, x0, y0) FROM cut WHERE colour = 'ignore') GROUP BY ALL""")
def label_pixel_counts(spark, sf):
    kept = chips.drop_ignored_chips(_cut25(spark, sf), _CHIP)
    return chips.label_pixel_counts(chips.recode_colors(kept, CLASSES), _CHIP)


def _sets(spark, sf):
    c = world.chip_labels(spark, sf).withColumns({"size": F.lit(300), "stride": F.lit(300)})
    return [c.where(F.col("dataset") == k) for k in ("en", "de", "fr", "es")]


@query(f"WITH {O.CHIP_LABELS} SELECT dataset, stem FROM chips WHERE building > 0 AND water > 0")
def merge_chip_sets(spark, sf):
    merged, _ = chips.merge_chip_sets(_sets(spark, sf), CLASSES)
    return merged.select("dataset", "stem")


@query(f"WITH {O.CHIP_LABELS} SELECT stem, count(*) sets FROM chips GROUP BY stem HAVING count(*) > 1")
def merge_chip_sets__repeated(spark, sf):
    return chips.merge_chip_sets(_sets(spark, sf))[1]


@query(f"WITH {O.CHIP_LABELS} SELECT stem FROM chips WHERE building > 0 OR water > 0")
def filter_chips(spark, sf):
    return world.chip_labels(spark, sf).where(chips.has_classes("labels", CLASSES)).select("stem")


@query(f"WITH {O.CHIP_LABELS} SELECT stem FROM chips WHERE building > 0 AND water > 0")
def filter_chips__all(spark, sf):
    return world.chip_labels(spark, sf).where(chips.has_classes("labels", CLASSES, "all")).select("stem")


_TOTALS = f"""{O.CHIP_LABELS}, fit AS (SELECT * FROM chips WHERE building > 0 OR water > 0), totals AS (
  SELECT 'building' AS label, CAST(sum(building) AS BIGINT) pixels FROM fit UNION ALL SELECT 'water', CAST(sum(water) AS BIGINT) FROM fit
  UNION ALL SELECT 'background', CAST(sum({CHIP_PIXELS} - building - water) AS BIGINT) FROM fit)"""


@query(f"WITH {_TOTALS} SELECT * FROM totals")
def class_pixel_totals(spark, sf):
    return chips.class_pixel_totals(world.chip_labels(spark, sf), CLASSES, CHIP_PIXELS)


@query(f"WITH {_TOTALS} SELECT label, round(1.0::DOUBLE / pixels / (SELECT sum(1.0::DOUBLE / pixels) FROM totals), 9) weight FROM totals")
def class_weights(spark, sf):
    return chips.class_weights(class_pixel_totals(spark, sf)).select("label", F.round("weight", 9).alias("weight"))


@query(f"""WITH {O.PIXELS}, w AS (SELECT colour, 1.0::DOUBLE / count(*) w FROM pixels WHERE colour <> 'ignore' GROUP BY colour)
  SELECT image_id, px, py, round(w / (SELECT sum(w) FROM w), 9) weight FROM pixels JOIN w USING (colour)""")
def sample_weights(spark, sf):
    """Each pixel with the weight of its label; the weights come from the pixels themselves."""
    p = chips.recode_colors(world.pixels(spark, sf), CLASSES).where("label is not null")
    weights = chips.class_weights(p.groupBy("label").agg(F.count("*").alias("pixels")))
    return p.join(weights, "label").select("image_id", "px", "py", F.round("weight", 9).alias("weight"))


@query(f"""WITH {O.CHIP_LABELS}, r AS (SELECT stem, row_number() OVER (ORDER BY stem) i, count(*) OVER () n FROM chips)
  SELECT stem, CASE WHEN i <= trunc(n * 0.75) THEN 'train' WHEN i <= trunc(n * (0.75::DOUBLE + 0.24::DOUBLE)) THEN 'validation' ELSE 'test' END split FROM r""")
def split(spark, sf):
    return chips.split(world.chip_labels(spark, sf).select("stem"))


@query()
def shuffled_batches(spark, sf):
    return chips.shuffled_batches(world.chip_labels(spark, sf).select("stem"))


@query(f"""WITH {O.CHIP_LABELS} SELECT dataset, split_part(stem, '-', 1) sheet, count(*) chips, CAST(grouping(dataset, split_part(stem, '-', 1)) AS INTEGER) "level"
  FROM chips GROUP BY ROLLUP (dataset, split_part(stem, '-', 1))""")
def chip_inventory(spark, sf):
    return chips.chip_inventory(world.chip_labels(spark, sf).withColumn("sheet", F.split_part("stem", F.lit("-"), F.lit(1))))


@query("""WITH f AS (SELECT vec_id % 5 video, vec_id // 5 frame, list_transform(embedding, lambda v: abs(v::DOUBLE)) h FROM embeddings),
l AS (SELECT *, lag(h) OVER (PARTITION BY video ORDER BY frame) b FROM f),
d AS (SELECT *, CASE WHEN b IS NOT NULL AND list_sum(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] + b[i] > 0 THEN (h[i] - b[i]) * (h[i] - b[i]) / (h[i] + b[i]) ELSE 0 END))
      / (len(h) / 4) > 0.22 THEN 1 ELSE 0 END c FROM l),
s AS (SELECT video, frame, CAST(sum(c) OVER (PARTITION BY video ORDER BY frame) AS BIGINT) shot FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY video, shot ORDER BY frame) i, count(*) OVER (PARTITION BY video, shot) n FROM s)
SELECT video, shot, min(frame) AS "first", max(frame) AS "last", max(CASE WHEN i = (n + 1) // 2 THEN frame END) keyframe FROM n GROUP BY video, shot""")
def shot_keyframes(spark, sf):
    frames = world.table(spark, sf, "embeddings").selectExpr("vec_id % 5 video", "vec_id div 5 frame", "transform(embedding, v -> abs(double(v))) histogram")
    return chips.shot_keyframes(frames, 0.22)


@query(f"WITH {O.PIXELS} SELECT image_id, px, py, CAST(CASE colour WHEN 'building' THEN 75 WHEN 'water' THEN 48 ELSE 0 END AS INTEGER) b, CAST(CASE colour WHEN 'building' THEN 25 WHEN 'water' THEN 130 ELSE 0 END AS INTEGER) g, CAST(CASE colour WHEN 'building' THEN 230 WHEN 'water' THEN 245 ELSE 0 END AS INTEGER) r FROM pixels")
def category_to_color(spark, sf):
    coded = chips.recode_colors(world.pixels(spark, sf), CLASSES)
    return chips.category_to_color(coded, CLASSES).select("image_id", "px", "py", "b", "g", "r")


@query("SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',') one_hot, CAST(CASE WHEN label = 3 THEN 1 ELSE 0 END AS DOUBLE) is_three FROM embeddings")
def one_hot(spark, sf):
    e = world.table(spark, sf, "embeddings")
    return e.select(
        "vec_id", F.array_join(chips.one_hot("label", 10).cast("array<string>"), ",").alias("one_hot"), F.when(F.col("label") == 3, 1.0).otherwise(0.0).alias("is_three")
    )


@query(f"""WITH {O.RINGS}, a AS (SELECT area, k, x0, y0, s, (CASE WHEN k % 4 = 0 THEN s * s * 3 / 4 ELSE s * s END) - CASE WHEN k % 7 = 0 AND k % 4 <> 0 THEN (s - 2 * (s // 4)) * (s - 2 * (s // 4)) ELSE 0 END px FROM parts)
  SELECT row_number() OVER (ORDER BY area, k) id, area, k polygon_id, CAST(px AS DOUBLE) area_px, CAST(x0 AS DOUBLE) x, CAST(y0 AS DOUBLE) y, CAST(s AS DOUBLE) w, CAST(s AS DOUBLE) h,
  CAST(CASE WHEN k % 4 = 0 THEN 14 ELSE 10 END AS INTEGER) numbers FROM a""")
def coco_annotations(spark, sf):
    rows = chips.coco_annotations(normalize_winding(world.obstacles(spark, sf, raw=True)))
    box = {n: F.element_at("bbox", i + 1) for i, n in enumerate("xywh")}
    return rows.select("id", "area", "polygon_id", "area_px", *(c.alias(n) for n, c in box.items()), F.size("segmentation").alias("numbers"))


@query(f"""WITH {O.PIXELS}, im AS (SELECT DISTINCT image_id FROM pixels) SELECT im.image_id, CAST(x AS INTEGER) px, CAST(y AS INTEGER) py, colour FROM im CROSS JOIN range(40) a(x) CROSS JOIN range(40) b(y)
  JOIN pixels p ON p.image_id = im.image_id AND p.px = x * 100 // 40 AND p.py = y * 100 // 40""")
def resize_chips(spark, sf):
    """Masks of 100 x 100 as 40 x 40, by the nearest pixel."""
    p = chips.recode_colors(world.pixels(spark, sf), CLASSES).select("image_id", "px", "py", F.coalesce("label", F.lit("ignore")).alias("colour"))
    return chips.resize_nearest(p, SIDE, SIDE, 40, 40)


@query()
def augment_chips(spark, sf):
    p = world.pixels(spark, sf).withColumn("stem", F.col("image_id").cast("string"))
    return chips.augment_geometry(p, SIDE, 2, 11).select("stem", "epoch", "px", "py", "ax", "ay", "b", "g", "r")


# ----------------------------------------------------------------------------------------------- evaluation

_PRED = """pred AS (SELECT vec_id pixel_id, label truth, 1 + label / 10.0::DOUBLE w, list_transform(embedding[1:10], lambda v: v::DOUBLE) s FROM embeddings),
arg AS (SELECT *, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) predicted FROM pred)"""


def _predicted(spark, sf):
    return world.scores(spark, sf).withColumn("predicted", evaluate.argmax_class("scores"))


@query(f"WITH {_PRED} SELECT pixel_id, predicted FROM arg")
def argmax_class(spark, sf):
    return _predicted(spark, sf).select("pixel_id", "predicted")


_MATRIX = f"{_PRED}, m AS (SELECT truth, predicted, sum(w) weight FROM arg GROUP BY ALL)"


@query(f"WITH {_MATRIX} SELECT truth, predicted, round(weight, 6) weight FROM m")
def confusion(spark, sf):
    m = evaluate.confusion(_predicted(spark, sf), "truth", "predicted", F.col("weight"))
    return m.select("truth", "predicted", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_PRED}, c AS (SELECT w, truth, i - 1 c, s[i] > 0.1 hit FROM (SELECT *, unnest(range(1, 11)) i FROM pred)),
t AS (SELECT sum(CASE WHEN hit AND c = truth THEN w ELSE 0 END) tp, sum(CASE WHEN hit AND c <> truth THEN w ELSE 0 END) fp, sum(CASE WHEN NOT hit AND c = truth THEN w ELSE 0 END) fn FROM c)
SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) recall, round(2 * tp / (2 * tp + fp + fn), 9) f1 FROM t""")
def precision_recall_f1(spark, sf):
    """At a threshold of 0.1, which some of these scores exceed."""
    r = evaluate.precision_recall_f1(world.scores(spark, sf), "scores", "truth", F.col("weight"), 0.1)
    return r.select(*(F.round(c, 9).alias(c) for c in r.columns))


@query(f"""WITH {_MATRIX}, k AS (SELECT truth c FROM m UNION SELECT predicted FROM m),
iou AS (SELECT c, (SELECT coalesce(sum(weight), 0) FROM m WHERE truth = c AND predicted = c) tp, (SELECT sum(weight) FROM m WHERE truth = c OR predicted = c) u FROM k)
SELECT round((SELECT sum(weight) FROM m WHERE truth = predicted) / (SELECT sum(weight) FROM m), 9) accuracy, round(avg(tp / u), 9) mean_iou FROM iou""")
def accuracy_iou(spark, sf):
    r = evaluate.accuracy_iou(evaluate.confusion(_predicted(spark, sf), "truth", "predicted", F.col("weight")))
    return r.select(*(F.round(c, 9).alias(c) for c in r.columns))


_HISTORY = """h AS (SELECT user_id run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) epoch, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""


def _history(spark, sf):
    return world.history(spark, sf).select("run", F.posexplode("val_loss").alias("i", "value")).select("run", (F.col("i") + 1).cast("long").alias("epoch"), "value")


@query(f"WITH {_HISTORY} SELECT run, arg_min(epoch, (value, epoch)) best_epoch, min(value) best FROM h GROUP BY run")
def best_epoch(spark, sf):
    return evaluate.best_epoch(_history(spark, sf))


@query(f"""WITH RECURSIVE {_HISTORY}, st AS (
  SELECT run, 0::BIGINT epoch, 'inf'::DOUBLE best, 0 AS wait FROM (SELECT DISTINCT run FROM h)
  UNION ALL SELECT h.run, h.epoch, CASE WHEN h.value < st.best - 0.001 THEN h.value ELSE st.best END, CASE WHEN h.value < st.best - 0.001 THEN 0 ELSE st.wait + 1 END
  FROM st JOIN h ON h.run = st.run AND h.epoch = st.epoch + 1 WHERE st.wait < 5
) SELECT run, CAST(min(CASE WHEN wait >= 5 THEN epoch END) AS INTEGER) stop_epoch FROM st GROUP BY run""")
def early_stop(spark, sf):
    return world.history(spark, sf).select("run", evaluate.early_stop("val_loss").alias("stop_epoch"))


@query("""WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'naive' WHEN 'view' THEN 'sweep' ELSE 'optimized' END AS mode, user_id + 41 vertices, value * 1000 ms FROM events),
s AS (SELECT mode, vertices, count(*) runs, avg(ms) / 1000 mean_s, stddev_pop(ms) / 1000 std_s FROM r GROUP BY ALL),
p AS (SELECT *, CASE mode WHEN 'naive' THEN pow(vertices / 41.0::DOUBLE, 3) WHEN 'sweep' THEN pow(vertices / 24.0::DOUBLE, 2) * ln(vertices / 24.0::DOUBLE)
  ELSE pow(vertices / 30.0::DOUBLE, 2) * ln(vertices / 30.0::DOUBLE) END / 1000 predicted_s FROM s)
SELECT mode, vertices, runs, round(mean_s, 6) mean_s, round(std_s, 6) std_s, round(predicted_s, 9) predicted_s, round(mean_s - predicted_s, 6) residual_s FROM p""")
def timing_summary(spark, sf):
    runs = world.table(spark, sf, "events").selectExpr(
        "CASE event_type WHEN 'click' THEN 'naive' WHEN 'view' THEN 'sweep' ELSE 'optimized' END mode", "user_id + 41 vertices", "value * 1000 ms"
    )
    r = evaluate.timing_summary(runs)
    return r.select("mode", "vertices", "runs", *(F.round(c, 9 if c == "predicted_s" else 6).alias(c) for c in ("mean_s", "std_s", "predicted_s", "residual_s")))


# ----------------------------------------------------------------------------------------------- design

_GRID = """g AS (SELECT p_partkey, CAST(1 + p_size % 10 / 10.0::DOUBLE AS DOUBLE) b, CAST(0.15 + p_partkey % 7 / 100.0::DOUBLE AS DOUBLE) c, w, v FROM part, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) w), (SELECT unnest([12.0::DOUBLE, 18.0::DOUBLE]) v))"""


@query(f"""WITH {_GRID}, f AS (SELECT *, b * c area, b / c ratio, 1.05::DOUBLE / (1 + 1.05::DOUBLE / (pi() * 0.8::DOUBLE * (b / c))) slope FROM g)
SELECT p_partkey, w mass_kg, v speed_ms, round(area, 9) wing_area, round(ratio, 9) aspect_ratio, round(2 * w / (1.225 * v * v * area), 9) lift, round(1.225 * v * c / 1.81e-5, 3) reynolds,
  round(-3.75::DOUBLE + 2 * w / (1.225 * v * v * area) / slope * (180 / pi()), 6) angle_deg, round(sqrt(2 * w / (1.225 * area * 1.4)), 9) stall_speed,
  CASE WHEN w / pow(area, 1.5) < 4 THEN 'glider' WHEN w / pow(area, 1.5) BETWEEN 5 AND 7 THEN 'trainer' WHEN w / pow(area, 1.5) BETWEEN 8 AND 10 THEN 'sport aerobatic'
       WHEN w / pow(area, 1.5) BETWEEN 11 AND 13 THEN 'racer' WHEN w / pow(area, 1.5) > 15 THEN 'scale' ELSE 'between' END band FROM f""")
def aero_sweep(spark, sf):
    grid = world.table(spark, sf, "part").selectExpr("p_partkey", "1 + p_size % 10 / 10D span_m", "0.15D + p_partkey % 7 / 100D chord_m", "explode(array(1D, 2D)) mass_kg")
    r = design.aero_sweep(grid.withColumn("speed_ms", F.explode(F.array(F.lit(12.0), F.lit(18.0)))))
    digits = {"wing_area": 9, "aspect_ratio": 9, "lift": 9, "reynolds": 3, "angle_deg": 6, "stall_speed": 9}
    return r.select("p_partkey", "mass_kg", "speed_ms", *(F.round(c, d).alias(c) for c, d in digits.items()), "band")


@query("""WITH d AS (SELECT c_custkey design_id, CAST(300 + c_custkey % 40 * 50 AS DOUBLE) mass_g, CAST(8 + c_custkey % 9 AS DOUBLE) speed_ms FROM customer),
m AS (SELECT s_suppkey motor_id, CAST(400 + s_suppkey % 60 * 50 AS DOUBLE) kv, CAST(200 + s_suppkey * 37 % 3000 AS DOUBLE) thrust_g, CAST(30 + s_suppkey * 13 % 170 AS DOUBLE) motor_mass_g, cells
  FROM supplier, (SELECT unnest([4, 5, 6, 7]) cells)),
f AS (SELECT design_id, motor_id, motor_mass_g, min(cells) cells, max(thrust_g) / max(mass_g) thrust_to_weight FROM d JOIN m ON thrust_g >= 1.5 * mass_g
  AND speed_ms / 0.65 / (kv * cells * 3.7 / 60) <= 0.30 GROUP BY ALL)
SELECT * FROM (SELECT design_id, motor_id, CAST(cells AS INTEGER) cells, round(thrust_to_weight, 9) thrust_to_weight,
  CAST(row_number() OVER (PARTITION BY design_id ORDER BY motor_mass_g, motor_id) AS INTEGER) place FROM f) WHERE place <= 3""")
def propulsion_sweep(spark, sf):
    d = world.table(spark, sf, "customer").selectExpr("c_custkey design_id", "double(300 + c_custkey % 40 * 50) mass_g", "double(8 + c_custkey % 9) speed_ms")
    m = world.table(spark, sf, "supplier").selectExpr(
        "s_suppkey motor_id", "double(400 + s_suppkey % 60 * 50) kv", "double(200 + s_suppkey * 37 % 3000) thrust_g", "double(30 + s_suppkey * 13 % 170) mass_g"
    )
    return design.propulsion_sweep(d, m).select("design_id", "motor_id", "cells", F.round("thrust_to_weight", 9).alias("thrust_to_weight"), "place")


_TAIL = """t AS (SELECT p_partkey, 0.3 + p_size % 10 / 100.0::DOUBLE s, 1.5::DOUBLE b, 0.2::DOUBLE c, 0.04 + p_partkey % 9 / 200.0::DOUBLE ta, 0.6 + p_partkey % 5 / 10.0::DOUBLE arm,
  0.02 + p_partkey % 4 / 100.0::DOUBLE fa, 3 + p_partkey % 6 AS dih, 0.4 + p_partkey % 3 / 10.0::DOUBLE lift, 4.0::DOUBLE tr, 0.25 + p_partkey % 11 / 50.0::DOUBLE cg FROM part)"""


@query(f"""WITH {_TAIL}, f AS (SELECT *, ta * arm / (s * c) vh, fa * arm / (s * c) vv, arm / b * dih / lift spiral FROM t),
n AS (SELECT *, 0.25 + (1 + 2 / (b / c)) / (1 + 2 / tr) * (1 - 4 / (b / c + 2)) * vh np FROM f)
SELECT p_partkey, round(vh, 9) vh, round(vv, 9) vv, round(spiral, 9) spiral, round(np - cg, 9) margin, round(np - 0.10::DOUBLE, 9) wanted_cg, vh BETWEEN 0.30 AND 0.60 vh_ok, vv BETWEEN 0.02 AND 0.05 vv_ok, spiral > 5 spiral_ok, vv * spiral BETWEEN 0.10 AND 0.20 roll_ok, np - cg BETWEEN 0.05 AND 0.15 margin_ok FROM n""")
def stability_sweep(spark, sf):
    grid = world.table(spark, sf, "part").selectExpr(
        "p_partkey", "0.3D + p_size % 10 / 100D wing_area", "1.5D span", "0.2D chord", "0.04D + p_partkey % 9 / 200D tail_area", "0.6D + p_partkey % 5 / 10D tail_arm",
        "0.02D + p_partkey % 4 / 100D fin_area", "0.6D + p_partkey % 5 / 10D fin_arm", "3 + p_partkey % 6 dihedral_deg", "0.4D + p_partkey % 3 / 10D lift", "4D tail_ratio",
        "0.25D + p_partkey % 11 / 50D cg",
    )
    r = design.stability_sweep(grid)
    return r.select("p_partkey", *(F.round(c, 9).alias(c) for c in ("vh", "vv", "spiral", "margin", "wanted_cg")), "vh_ok", "vv_ok", "spiral_ok", "roll_ok", "margin_ok")


@query("""SELECT l_returnflag, l_linestatus, count(*) parts, round(sum(l_quantity * l_extendedprice), 2) total, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) "level"
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def parts_rollup(spark, sf):
    parts = world.table(spark, sf, "lineitem").selectExpr("l_returnflag", "l_linestatus", "l_extendedprice unit", "l_quantity count", "double(null) total")
    r = design.parts_rollup(parts, ["l_returnflag", "l_linestatus"])
    return r.withColumn("total", F.round("total", 2))


@query("""SELECT l_suppkey store, count(*) items, round(sum(l_extendedprice), 2) price, round(sum(l_extendedprice * (1 + l_tax)), 2) paid,
  round(sum(l_extendedprice * (1 + l_tax)) - sum(l_extendedprice), 2) fees FROM lineitem GROUP BY l_suppkey""")
def store_costs(spark, sf):
    receipts = world.table(spark, sf, "lineitem").selectExpr("l_suppkey store", "l_extendedprice price", "l_extendedprice * (1 + l_tax) paid")
    r = design.store_costs(receipts)
    return r.select("store", "items", *(F.round(c, 2).alias(c) for c in ("price", "paid", "fees")))
