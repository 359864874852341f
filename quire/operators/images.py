"""Images as pixel rows (image_id, x, y, r, g, b, a) and as metadata rows (image_id, width, height).

An image's pixels meet only in its own partial aggregates; no image is ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import round_half_up

# Tolerances, thresholds, crop ratios and preview bounds.
TOLERANCE = {"light": 38, "balanced": 54, "strong": 72}
WHITE = {"gentle": 248, "balanced": 236, "strong": 220}
RATIOS = {"1:1": (1, 1), "4:3": (4, 3), "16:9": (16, 9)}
PREVIEW_EDGE, PREVIEW_PIXELS = 1600, 1_500_000
MAX_GIF_WIDTH = 1400


def image_size(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def corner_stats(pixels: DataFrame) -> DataFrame:
    """image_id, red, green, blue (means of the four corners), hex, spread (largest distance of two corners)."""
    size = image_size(pixels)
    corners = pixels.join(size, "image_id").filter(((F.col("x") == 0) | (F.col("x") == F.col("w") - 1)) & ((F.col("y") == 0) | (F.col("y") == F.col("h") - 1)))
    facts = []
    for name, (at_x, at_y) in {"tl": ("x = 0", "y = 0"), "tr": ("x = w - 1", "y = 0"), "bl": ("x = 0", "y = h - 1"), "br": ("x = w - 1", "y = h - 1")}.items():
        hit = F.expr(f"{at_x} AND {at_y}")
        facts += [F.max(F.when(hit, F.col(c).cast("double"))).alias(f"{name}_{c}") for c in "rgb"]
    wide = corners.groupBy("image_id").agg(*facts)
    names = ("tl", "tr", "bl", "br")
    mean = {c: sum((F.col(f"{n}_{c}") for n in names[1:]), F.col(f"{names[0]}_{c}")) / 4 for c in "rgb"}
    gaps = [F.sqrt(sum(((F.col(f"{m}_{c}") - F.col(f"{n}_{c}")) * (F.col(f"{m}_{c}") - F.col(f"{n}_{c}")) for c in "rgb"), F.lit(0.0))) for i, m in enumerate(names) for n in names[i + 1 :]]
    two = lambda x: F.lower(F.lpad(F.hex(round_half_up(x).cast("long")), 2, "0"))
    return wide.select("image_id", mean["r"].alias("red"), mean["g"].alias("green"), mean["b"].alias("blue"), F.concat(F.lit("#"), *[two(mean[c]) for c in "rgb"]).alias("hex"), round_half_up(F.greatest(*gaps)).alias("spread"))


def remove_background(pixels: DataFrame, cleanup: str = "balanced", background: str = "transparent") -> DataFrame:
    """``pixels`` with the flat colour of the corners made transparent, or laid on white or black, and softened
    (pixels left in between)."""
    tolerance, fill = TOLERANCE[cleanup], 0 if background == "black" else 255
    corners = corner_stats(pixels).select("image_id", "red", "green", "blue")
    joined = pixels.join(corners, "image_id")
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    distance = F.sqrt(square("r", "red") + square("g", "green") + square("b", "blue"))
    mask = round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (distance - F.lit(tolerance * 0.55)) / F.lit(tolerance * 0.65) * 255)))
    masked = joined.withColumn("alpha", F.least(F.col("a").cast("long"), mask))
    removed, softened = (F.col("a") - F.col("alpha")).alias("removed"), ((F.col("alpha") > 0) & (F.col("alpha") < F.col("a"))).alias("softened")
    if background == "transparent":
        return masked.select("image_id", "x", "y", "r", "g", "b", F.col("alpha").alias("a"), removed, softened)
    laid = [round_half_up(F.col(c) * (F.col("alpha") / 255) + fill * (1 - F.col("alpha") / 255)).alias(c) for c in "rgb"]
    return masked.select("image_id", "x", "y", *laid, F.lit(255).cast("long").alias("a"), removed, softened)


def background_outcome(done: DataFrame) -> DataFrame:
    """image_id, removed_percent, softened_percent of remove_background's rows."""
    n = F.count("*")
    return done.groupBy("image_id").agg(round_half_up(F.sum("removed") / (n * 255) * 100).alias("removed_percent"), round_half_up(F.count_if("softened") / n * 100).alias("softened_percent"))


def white_to_alpha(pixels: DataFrame, mode: str = "balanced") -> DataFrame:
    """Near-white pixels become transparent, those up to 28 levels darker partly."""
    threshold = WHITE[mode]
    whiteness = F.least("r", "g", "b")
    alpha = F.when(whiteness >= threshold, 0).when(whiteness > threshold - 28, round_half_up(F.col("a") * ((threshold - whiteness) / 28))).otherwise(F.col("a"))
    return pixels.select("image_id", "x", "y", "r", "g", "b", alpha.cast("long").alias("a"))


def crop_plan(meta: DataFrame, ratio: str = "free", scale: float = 100, focus_x: float = 50, focus_y: float = 50) -> DataFrame:
    """image_id, x, y, width, height, retained_percent of the largest crop of a ratio, scaled and placed."""
    if not (40 <= scale <= 100 and 0 <= focus_x <= 100 and 0 <= focus_y <= 100):
        raise ValueError("crop scale must be 40 to 100, focus 0 to 100")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    r = w / h if ratio in ("free", "original") else F.lit(RATIOS[ratio][0] / RATIOS[ratio][1])
    tall = w / r > h
    max_w, max_h = F.when(tall, h * r).otherwise(w), F.when(tall, h).otherwise(w / r)
    out_w = F.greatest(F.lit(1), F.least(round_half_up(w), round_half_up(max_w * (scale / 100))))
    out_h = F.greatest(F.lit(1), F.least(round_half_up(h), round_half_up(max_h * (scale / 100))))
    sized = meta.select("image_id", w.alias("w"), h.alias("h"), out_w.alias("width"), out_h.alias("height"))
    at = lambda room, focus: round_half_up(F.greatest(F.lit(0), room) * F.lit(focus / 100))
    kept = F.greatest(F.lit(1), F.least(F.lit(100), round_half_up(F.col("width") * F.col("height") / (F.col("w") * F.col("h")) * 100)))
    return sized.select("image_id", at(round_half_up(F.col("w")) - F.col("width"), focus_x).alias("x"), at(round_half_up(F.col("h")) - F.col("height"), focus_y).alias("y"), "width", "height", kept.alias("retained_percent"))


def crop_pixels(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "width", "height")
    inside = pixels.join(p, "image_id").filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("width")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("height")))
    return inside.select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "r", "g", "b", "a")


def rotate_pixels(pixels: DataFrame, angle: int) -> DataFrame:
    """Turned clockwise by 90, 180 or 270 degrees."""
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")
    moved = {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[angle % 360]
    return pixels.join(image_size(pixels), "image_id").select("image_id", moved[0].alias("x"), moved[1].alias("y"), "r", "g", "b", "a")


def size_columns(meta: DataFrame, width: int, scale: int = 2) -> DataFrame:
    """image_id and the sizes of a proportional resize, an upscaling by 2 or 4, and a bounded preview."""
    if scale not in (2, 4):
        raise ValueError("images are upscaled by 2 or 4")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    height = F.greatest(F.lit(1), round_half_up(h * (F.lit(width) / w)))
    direction = F.when(w == width, "unchanged").when(w < width, "enlarged").otherwise("reduced")
    factor = F.least(F.lit(1.0), F.lit(PREVIEW_EDGE) / F.greatest(w, h), F.sqrt(F.lit(PREVIEW_PIXELS) / (w * h)))
    return meta.select(
        "image_id",
        F.lit(width).alias("resized_width"), height.alias("resized_height"), direction.alias("direction"), round_half_up(F.lit(width) / w * 100).alias("resize_percent"),
        (w * scale).cast("long").alias("up_width"), (h * scale).cast("long").alias("up_height"), (w * h * scale * scale).cast("long").alias("up_pixels"), (w * h * scale * scale * 4).cast("long").alias("up_bytes"),
        F.greatest(F.lit(1), F.floor(w * factor)).alias("preview_width"), F.greatest(F.lit(1), F.floor(h * factor)).alias("preview_height"),
    )


def batch_shape(frames: DataFrame, delay_ms: int = 500) -> DataFrame:
    """batch_id, frames, width, height, duration_ms, cropped of ``frames(batch_id, seq, width, height)``: the first
    frame's shape, and how many frames have another one."""
    first = frames.groupBy("batch_id").agg(F.count("*").alias("frames"), F.min(F.struct("seq", "width", "height")).alias("f"))
    first = first.select("batch_id", "frames", F.col("f.width").alias("fw"), F.col("f.height").alias("fh"))
    other = frames.join(first, "batch_id").groupBy("batch_id").agg(F.count_if(F.col("width") * F.col("fh") != F.col("height") * F.col("fw")).alias("cropped"))
    width = F.least(F.lit(MAX_GIF_WIDTH), F.col("fw"))
    return first.join(other, "batch_id").select("batch_id", "frames", width.alias("width"), F.greatest(F.lit(1), round_half_up(width * (F.col("fh") / F.col("fw")))).alias("height"), (F.col("frames") * delay_ms).alias("duration_ms"), "cropped")


def privacy_regions(meta: DataFrame, detections: DataFrame, focus_x: float = 50, focus_y: float = 38, size: float = 34) -> DataFrame:
    """image_id, x, y, width, height, mode, n_regions: detections cut to the image, those outside left out; an
    image without one gets a centred area."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")

    def cut(x: Column, y: Column, rw: Column, rh: Column) -> list[Column]:
        bound = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
        left, top, right, bottom = bound(x, w), bound(y, h), bound(x + rw, w), bound(y + rh, h)
        return [left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")]

    shapes = meta.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    found = detections.select("image_id", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("width").alias("dw"), F.col("height").alias("dh")).join(shapes, "image_id").filter("dw > 0 AND dh > 0")
    found = found.select("image_id", *cut(F.col("dx"), F.col("dy"), F.col("dw"), F.col("dh"))).filter("width > 0 AND height > 0")
    counts = found.groupBy("image_id").agg(F.count("*").alias("n_regions"))
    side = F.least(w, h) * F.lit(size / 100)
    spare = shapes.join(counts, "image_id", "left_anti").select("image_id", *cut(w * F.lit(focus_x / 100) - side / 2, h * F.lit(focus_y / 100) - side * 1.12 / 2, side, side * 1.12))
    detected = found.join(counts, "image_id").withColumn("mode", F.lit("detected"))
    return detected.unionByName(spare.withColumn("mode", F.lit("centered-fallback")).withColumn("n_regions", F.lit(1).cast("long")))


def size_change(df: DataFrame) -> DataFrame:
    """``df(id, input, output)`` with saved, percent, status and keep_original (the output isn't smaller)."""
    saved = F.col("input") - F.col("output")
    good = (F.col("input") > 0) & (F.col("output") >= 0)
    status = F.when(~good | good.isNull(), None).when(saved > 0, "reduced").when(saved < 0, "increased").otherwise("unchanged")
    return df.select("id", F.when(good, saved).alias("saved"), F.when(good, saved / F.col("input") * 100).alias("percent"), status.alias("status"), F.when(good, saved <= 0).alias("keep_original"))


def batch_outcomes(results: DataFrame) -> DataFrame:
    """Of ``results(job_id, status, direction, percent, pixels, format)`` one row a job."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("reduced", "increased", "unchanged")]
    ways = [F.count_if(F.col("direction") == d).alias(d) for d in ("enlarged", "shrunk", "same")]
    return results.groupBy("job_id").agg(F.count("*").alias("n"), *counts, *ways, F.min("percent").alias("least_percent"), F.max("percent").alias("most_percent"), F.sum("pixels").alias("pixels"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"))
