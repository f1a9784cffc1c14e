"""Entry and exit zones: components of candidate masks, their scores, the choice of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.operators import pixels
from flightloom.operators.regions import flag_in_region, track_ends
from flightloom.sources.scratch import written

PX = pixels.PX


def motion_scale(heat: DataFrame) -> DataFrame:
    return heat.where("energy > 1e-6").groupBy("video_id").agg(F.percentile("energy", F.lit(0.95)).alias("scale"))


def with_evidence(mask: DataFrame, background: DataFrame, heat: DataFrame, dark_percent: float) -> DataFrame:
    """Pixels of a mask with dark (0/1) and motion (0..1)."""
    edge = background.groupBy("video_id").agg(F.percentile("v", F.lit(min(60.0, max(1.0, dark_percent)) / 100)).alias("dark_edge"))
    px = mask.join(background.select(*PX, F.col("v").alias("b")), PX, "left").join(edge, "video_id", "left").join(heat.select(*PX, "energy"), PX, "left").join(motion_scale(heat), "video_id", "left")
    moving = F.least(F.greatest(F.coalesce("energy", F.lit(0.0)) / F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    return px.withColumns({"dark": F.when(F.col("b") <= F.col("dark_edge"), 1.0).otherwise(0.0), "motion": moving})


def score_components(mask: DataFrame, background: DataFrame, heat: DataFrame, size: tuple[int, int], annotated: bool = False, dark_percent: float = 18.0, min_ratio: float = 0.002) -> DataFrame:
    """A row for each component of the mask: box, area, ratios, score; annotated
    ones score above all others."""
    total = max(1, size[0] * size[1])
    c = F.col
    rows = with_evidence(pixels.components(mask.select(*PX), ["video_id"]), background, heat, dark_percent).groupBy("video_id", "component").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("area"), F.avg("dark").alias("dark_ratio"), F.avg("motion").alias("motion_density")
    )
    rows = rows.where(c("area") >= max(1, round(min_ratio * total))).withColumn("area_ratio", c("area") / total)
    base = 0.42 * c("motion_density") + 0.34 * c("dark_ratio") + 0.24 * (1 - F.least(F.lit(1.0), F.abs(c("area_ratio") - 0.04) / 0.12))
    return rows.withColumn("score", 1.0 + F.least(F.lit(1.0), c("area_ratio") * 10) + F.least(F.lit(0.1), base) if annotated else base)


def top_zones(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k best components of each video as zones, ties to the first."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "component"))
    return rows.withColumn("zone_id", rank).where(F.col("zone_id") <= k)


#: Kernels of the candidate masks, fixed values.
MOTION_KERNEL, DARK_KERNEL = 7, 9


def candidate_masks(background: DataFrame, heat: DataFrame, size: tuple[int, int], method: str = "hybrid", motion_percent: float = 94.0, dark_percent: float = 18.0, connect: int = 18, mask: DataFrame | None = None, kernels: tuple[int, int] = (MOTION_KERNEL, DARK_KERNEL)) -> dict[str, DataFrame]:
    """Pixels of the candidate masks by source: a given one, or moving ones, dark
    ones, or (hybrid) moving ones and the dark ones near them; each closed twice and opened."""
    if method not in ("hybrid", "annotation", "motion", "dark"):
        raise ValueError(f"method must be hybrid, annotation, motion or dark, got {method}")
    if mask is not None or method == "annotation":
        return {} if mask is None else {"annotation": mask}
    clean = lambda px, k: pixels.cleaned(px, pixels.ellipse(k), size)
    moving = clean(pixels.above_percentile(heat, motion_percent), kernels[0])
    dark = clean(pixels.below_percentile(background, dark_percent), kernels[1])
    if method == "motion":
        return {"motion_heatmap": moving}
    if method == "dark":
        return {"dark_regions": dark}
    moving, dark = written(moving), written(dark)  # long plans that are read more than once
    near = pixels.dilate(moving, pixels.ellipse(2 * connect + 1), size)
    still = dark.join(moving.select("video_id").distinct(), "video_id", "left_anti")  # without motion there is no gate
    return {"motion_heatmap": moving, "dark_regions": dark.select(*PX).intersect(near).union(still.select(*PX))}


def candidate_zones(background: DataFrame, heat: DataFrame, size: tuple[int, int], **options) -> DataFrame | None:
    """Pixels of all candidate masks."""
    masks = list(candidate_masks(background, heat, size, **options).values())
    out = masks[0] if masks else None
    for more in masks[1:]:
        out = out.union(more).distinct()
    return out


def entry_zones(background: DataFrame, heat: DataFrame, size: tuple[int, int], k: int = 3, dilate_px: int = 8, min_ratio: float = 0.002, **options) -> tuple[DataFrame, DataFrame]:
    """(zones, pixels): the k best components of the candidate masks, widened, their
    pixels labelled and scored anew, so that zones are what the final mask shows."""
    rows = parts = None
    for source, mask in candidate_masks(background, heat, size, **options).items():
        given, mask = source == "annotation", written(mask.select(*PX))
        own = pixels.components(mask.select(*PX), ["video_id"]).withColumn("source", F.lit(source))
        scored = score_components(mask, background, heat, size, given, min_ratio=min_ratio).withColumn("source", F.lit(source))
        rows, parts = (scored, own) if rows is None else (rows.unionByName(scored), parts.unionByName(own))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "source", "component"))
    best = rows.withColumn("_r", rank).where(F.col("_r") <= k).select("video_id", "source", "component")
    final = parts.join(best, ["video_id", "source", "component"], "left_semi").select(*PX).distinct()
    final = written(pixels.dilate(final, pixels.ellipse(2 * dilate_px + 1), size) if dilate_px > 0 else final)
    return top_zones(score_components(final, background, heat, size, min_ratio=0.0), size[0] * size[1]), final


def source_scores(masks: DataFrame, points: DataFrame, background: DataFrame, heat: DataFrame, size: tuple[int, int], vegetation: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """A row for each candidate source (kind of mask) with its evidence and score."""
    # fixed values
    w = {"motion_weight": 0.25, "dark_weight": 0.25, "endpoint_weight": 0.30, "area_weight": 0.20, "vegetation_overlap_penalty": 0.45, "dark_percentile": 18.0, "ideal_area_ratio": 0.04, "max_reasonable_area_ratio": 0.18, "cavemark_bias": 0.12, "cave_zones_bias": 0.0, "valid_region_bias": -0.15} | (weights or {})
    c = F.col
    px = with_evidence(masks.select("kind", *PX).distinct(), background, heat, w["dark_percentile"])
    if vegetation is not None:
        px = px.join(vegetation.select(*PX, F.lit(1.0).alias("veg")), PX, "left")
    else:
        px = px.withColumn("veg", F.lit(None).cast("double"))
    area = px.groupBy("video_id", "kind").agg(F.count("*").alias("area"), F.avg("dark").alias("dark_ratio"), F.avg("motion").alias("motion_support"), F.avg(F.coalesce("veg", F.lit(0.0))).alias("vegetation_overlap"))
    kinds = masks.select("video_id", "kind").distinct()
    meets = None
    for row in kinds.select("kind").distinct().orderBy("kind").collect():  # a handful of sources
        ends = track_ends(flag_in_region(points, masks.where(c("kind") == row["kind"]))).withColumn("kind", F.lit(row["kind"]))
        one = ends.groupBy("video_id", "kind").agg(F.avg(F.when(c("start_in") | c("end_in"), 1.0).when(c("mid_in"), 0.5).otherwise(0.0)).alias("endpoint_support"))
        meets = one if meets is None else meets.unionByName(one)
    out = area.join(meets, ["video_id", "kind"], "left") if meets is not None else area.withColumn("endpoint_support", F.lit(0.0))
    ideal = max(1e-6, w["ideal_area_ratio"])
    out = out.withColumn("area_ratio", c("area") / max(1, size[0] * size[1]))
    shape = 1 - F.least(F.lit(1.0), F.abs(c("area_ratio") - ideal) / max(ideal, w["max_reasonable_area_ratio"]))
    bias = F.when(c("kind") == "cavemark", w["cavemark_bias"]).when(c("kind") == "cave_zones", w["cave_zones_bias"]).when(c("kind") == "valid_region", w["valid_region_bias"]).otherwise(0.0)
    score = w["motion_weight"] * c("motion_support") + w["dark_weight"] * c("dark_ratio") + w["endpoint_weight"] * F.coalesce("endpoint_support", F.lit(0.0)) + w["area_weight"] * shape + bias - w["vegetation_overlap_penalty"] * c("vegetation_overlap")
    return out.withColumn("score", score)


def choose_source(scores: DataFrame, wanted: str = "auto") -> DataFrame:
    """The best source of each video, or the wanted one, valid_region standing in for it; ties by rank of kinds."""
    rank = F.when(F.col("kind") == "cavemark", 0).when(F.col("kind") == "cave_zones", 1).otherwise(2)
    key = F.struct("score", (-rank).alias("r")) if wanted == "auto" else F.struct((F.col("kind") == wanted).cast("int").alias("w"), (F.col("kind") == "valid_region").cast("int").alias("v"), "score")
    return scores.groupBy("video_id").agg(F.max_by(F.struct("kind", "score"), key).alias("s")).select("video_id", F.col("s.kind").alias("kind"), F.col("s.score").alias("score"))
