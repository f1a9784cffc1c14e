"""The whole run: frames, detections or points of many videos in; tracks,
assessments, events and audits out. Steps come in a fixed order; a result that
later steps read more than once is written to the shared folder, so that every
plan is short and a lost executor costs no more than tasks of one step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.functions.expressions import area_scale, resolution_scale
from flightloom.operators import dense, fast_events, filters, grouping, layers, merging, pairs, pixels, regions, summary, tracking, windows, zones
from flightloom.sources import config as settings
from flightloom.sources.scratch import written

KEY = summary.KEY


@dataclass
class Run:
    raw_points: DataFrame
    merged: DataFrame
    merges: DataFrame | None
    assessments: DataFrame
    points: DataFrame
    decisions: DataFrame | None
    pairs: DataFrame | None
    rescues: DataFrame | None
    events: DataFrame
    fast_events: DataFrame | None
    metrics: DataFrame
    heatmap_events: DataFrame | None = None
    background: DataFrame | None = None
    region: DataFrame | None = None
    zones: DataFrame | None = None
    source_scores: DataFrame | None = None
    trails: DataFrame | None = None


def filter_detections(detections: DataFrame, cfg: dict, region: DataFrame | None = None) -> DataFrame:
    """Area, region, ROI and crowding, in this order."""
    d = filters.by_area(detections, cfg["min_area"], cfg["max_area"])
    if region is not None:
        d = regions.flag_in_region(d, region, "_in").where("_in").drop("_in")
    d = filters.by_roi(d, cfg["roi_x_min"], cfg["roi_x_max"], cfg["roi_y_min"], cfg["roi_y_max"])
    return filters.drop_crowded_frames(d, cfg["max_detections_per_frame"])


def gate_bursts(detections: DataFrame, cfg: dict) -> DataFrame:
    """Detections of the frames that the burst gate keeps; off unless all its settings are positive."""
    gate = [cfg[f"temporal_burst_{k}"] for k in ("min_detections", "window_frames", "trigger_frames", "cooldown_frames")]
    if min(gate) <= 0:
        return detections
    kept = windows.burst_gate(detections.groupBy("video_id", "frame").agg(F.count("*").alias("n")), *gate).where("keep")
    return detections.join(kept.select("video_id", "frame"), ["video_id", "frame"], "left_semi")


def sampled_background(frames: DataFrame, counts: DataFrame, cfg: dict, fps: float, section: str = "background") -> DataFrame:
    """Images of the median of each video's sampled frames in the section's context, as whole levels."""
    b = cfg["background"]
    numbers = written(dense.sample_numbers(dense.context(counts, fps, *settings.context_seconds(cfg, section)), b["sample_frames"], b["uniform_sampling"]))
    return written(dense.background(dense.at(frames, numbers)))


def valid_region(images: DataFrame, cfg: dict) -> DataFrame:
    """Pixels of each video's valid region from its image, by the method of the settings."""
    v = cfg["valid_region"]
    band = pixels.valid_band(dense.column_profile(images, v["blur_kernel_size"]), v["profile_smooth_window"], v["threshold_ratio"], v["safety_margin"], v["min_region_width_ratio"])
    deep = layers.Layers(v["blur_kernel_size"], v["depth_percentile"], v["depth_morph_kernel"], v["depth_min_area_ratio"], tuple(settings.number_list(v["depth_layer_percentiles"], float)), tuple(settings.number_list(v["depth_layer_dilate_px"])))
    names = ("search_up_px", "search_down_px", "smooth_window", "gradient_quantile", "regularization", "max_step_px", "downward_bias", "regularization_mix", "deepest_strong_ratio")
    contour = layers.Contour(*(v[f"bottom_contour_{n}"] for n in names)) if v["bottom_contour_snap_enabled"] else None
    kernel = partial(layers.region_mask, method=str(v["method"]).lower(), mode=str(v["hybrid_combine_mode"]).lower(), cfg=deep, contour=contour)
    return dense.region_masks(images, band, kernel)


def vegetation_of(frames: DataFrame, counts: DataFrame, cfg: dict, size: tuple[int, int]) -> DataFrame:
    """Pixels of the restless parts of each video, widened; radii and areas follow the resolution if asked for."""
    v = cfg["vegetation_noise"]
    scale = bool(v["auto_scale_with_resolution"]), (v["reference_width"], v["reference_height"])
    samples = dense.vegetation_samples(frames, counts, v["auto_sample_frames"], v["auto_max_frame_for_sampling"])
    mask = dense.vegetation_mask(samples, v["auto_percentile"], area_scale(v["auto_min_component_area"], size, *scale))
    wide = round(resolution_scale(v["mask_dilate_px"], size, *scale))
    return written(pixels.dilate(mask, pixels.ellipse(2 * wide + 1), size) if wide > 0 else mask)


def choose_region(points: DataFrame, background: DataFrame, heat: DataFrame, cfg: dict, size: tuple[int, int], vegetation: DataFrame | None, valid: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(pixels of the entry zone, zones, scores of the sources): the valid region and
    the zones are scored by what they cover; the wanted one, or the best, is it."""
    masks, found = None, None
    if valid is not None:
        masks = valid.withColumn("kind", F.lit("valid_region"))
    z = cfg["cave_zones"]
    if z["enabled"]:
        found, px = zones.entry_zones(background, heat, size, z["max_components"], z["dilate_px"], z["min_component_area_ratio"], method=z["method"], motion_percent=z["motion_percentile"], dark_percent=z["dark_percentile"], connect=z["motion_dark_connect_dilate_px"])
        px = px.withColumn("kind", F.lit("cave_zones"))
        masks = px if masks is None else masks.unionByName(px)
    if masks is None:
        return None, None, None
    masks = written(masks)
    scores = written(zones.source_scores(masks, points, background, heat, size, vegetation))
    chosen = zones.choose_source(scores, cfg["tracking"]["entry_exit_zone_source"]).select("video_id", "kind")
    return written(masks.join(chosen, ["video_id", "kind"]).select(*pixels.PX)), found, scores


def run(
    config: dict, size: tuple[int, int], fps: float = 25.0, detections: DataFrame | None = None, raw_points: DataFrame | None = None, region: DataFrame | None = None, vegetation: DataFrame | None = None, secondary: DataFrame | None = None, secondary_points: DataFrame | None = None, frames: DataFrame | None = None,
    chunk_frames: int | None = None,
) -> Run:
    """region, vegetation: pixels (video_id, x, y). secondary: detections of a
    second pass, fused with the first; secondary_points: tracks of another
    tracker, added where no primary track accompanies them. frames: dense (video_id, frame, h, w,
    pixels) or pixel rows (video_id, frame, x, y, v of 0..255), which are made dense: detections come from
    them if none are given, within their valid region if asked for, the entry region (where no region is given) from
    that and their zones, and heat events if these are on. Each video's samples are placed in its own frames.
    chunk_frames: long busy videos are tracked in chunks of so many frames (``tracking.track_chunks``)."""
    config = settings.load(config)
    t, det = config["tracking"], config["detection"]
    scaled = lambda v: resolution_scale(v, size, bool(t["auto_scale_with_resolution"]), (t["reference_width"], t["reference_height"]))
    background = valid = images = counts = None
    if frames is not None:
        frames = frames if "pixels" in frames.columns else written(dense.from_pixels(frames))
        counts = written(dense.frame_counts(frames))
        images = sampled_background(frames, counts, config, fps)
        background = dense.to_pixels(images)
        if config["valid_region"]["enabled"]:
            own = settings.context_seconds(config, "valid_region") != settings.context_seconds(config, "background")
            valid = written(valid_region(sampled_background(frames, counts, config, fps, "valid_region") if own else images, config))
    if raw_points is None:
        inside = valid if region is None and valid is not None and config["valid_region"]["apply_to_detection"] else region
        d = dense.detect(frames, images, det, inside) if detections is None else filter_detections(detections, det, inside)
        if secondary is not None:
            s = config["secondary_detection"]
            d = tracking.fuse_detections(d, filter_detections(secondary, settings.secondary_detection(det, s)), s["dedupe_max_distance_px"], s["dedupe_min_iou"]).drop("origin")
        options = {"chunk": chunk_frames, "max_distance": scaled(t["max_distance"]), "max_missed": t["max_missed"], "fps": fps}
        if t["tracker"] == "kalman":
            options |= {"sigma": t["kalman_sigma_acc"], "measured": t["kalman_measurement_std"], "strong_area": t["kalman_high_area_threshold"]}
        raw_points = tracking.track(gate_bursts(written(d), det), t["tracker"], **options)
    raw_points = written(raw_points)
    v, found_zones, scores = config["vegetation_noise"], None, None
    h = config["heatmap_events"]
    blur = h["blur_kernel"] if h["blur_kernel"] > 0 and h["blur_kernel"] % 2 else 5
    if vegetation is None and frames is not None and v["enabled"]:
        vegetation = vegetation_of(frames, counts, config, size)
    if region is None and frames is not None and (config["valid_region"]["enabled"] or config["cave_zones"]["enabled"]):
        heat = dense.to_pixels(written(dense.motion_energy(frames, h["threshold"], blur, 3)), "energy", "f8", "energy")
        region, found_zones, scores = choose_region(raw_points, background, heat, config, size, vegetation, valid)
    if vegetation is not None and region is not None and background is not None and v["enabled"] and v["exclude_entry_exit_zones"]:
        wide = round(resolution_scale(v["exclude_entry_exit_dilate_px"], size, bool(v["auto_scale_with_resolution"]), (v["reference_width"], v["reference_height"])))
        vegetation = written(layers.exclude_zone(vegetation, region, background, v["entry_exit_exclusion_mode"], wide, v["entry_exit_keep_texture_percentile"], v["entry_exit_keep_min_intensity_percentile"], v["entry_exit_keep_min_gradient"], size))
    merges, merged = None, raw_points
    if t["auto_merge_suggested"]:
        merges = written(merging.auto_merges(raw_points, t["merge_max_gap_frames"], scaled(t["merge_max_endpoint_distance"]), t["merge_overlap_min_common_frames"], scaled(t["merge_overlap_max_mean_distance"]), t["merge_overlap_min_direction_cosine"], scaled(t["merge_overlap_proximity_override_distance"]), t["merge_max_group_overlap_frames"], scaled(t["merge_duplicate_max_distance"]), t["merge_max_group_size"]))
        merged = written(grouping.apply_merges(raw_points, merges))
    stripped = None
    if vegetation is not None and v["enabled"]:
        diag = max(1.0, (size[0] ** 2 + size[1] ** 2) ** 0.5)
        stripped = windows.strip_jitter(regions.flag_in_region(merged, vegetation), "inside", v["min_motion_ratio_per_sec"] * diag, v["min_consecutive_points"], v["drop_all_points_in_mask"]).drop("inside")
    kept = stripped if stripped is not None else merged
    directions = None
    if region is not None:
        gate = pixels.dilate(region, pixels.ellipse(2 * t["valid_region_gate_dilate_px"] + 1), size) if t["valid_region_gate_dilate_px"] > 0 else region
        centre = regions.region_centre(gate)
        directions = regions.full_directions(regions.flag_in_region(kept, gate), centre, float(size[1]))
    assessments = written(filters.assess(merged, filters.TrackFilter.from_config(t), fps, size, stripped, directions))
    points, rescues = filters.accepted_points(kept, assessments), None
    if t["rescue_crossing_continuations"]:
        rescues = written(grouping.crossing_rescues(merged, points, assessments))
        points = grouping.apply_rescues(points, merged, rescues)
    if t["rescue_motion_candidates"] and region is not None:
        wide = pixels.dilate(region, pixels.ellipse(2 * t["rescue_motion_interaction_dilate_px"] + 1), size) if t["rescue_motion_interaction_dilate_px"] > 0 else region
        touching = regions.flag_in_region(merged, wide).where("inside")
        points = filters.rescue_by_motion(points, merged.select(*points.columns), assessments, touching, tuple(r.strip() for r in t["rescue_motion_reject_reasons"].split(";") if r.strip()), t["rescue_motion_min_points"], scaled(t["rescue_motion_min_displacement"]), scaled(t["rescue_motion_min_path_length"]), t["rescue_motion_min_mean_speed"], t["rescue_motion_min_straightness"])
    points = written(points)
    if t["dedupe_coexisting_tracks"]:
        points = points.join(grouping.coexisting_duplicates(points), KEY, "left_anti")
    decisions = found_pairs = None
    if t["enable_track_deduplication"]:
        found_pairs = written(pairs.duplicate_pairs(points, scaled(t["max_spatial_distance_px"]), t["max_temporal_gap_frames"], t["min_direction_similarity"], t["min_speed_similarity"]))
        decisions = written(grouping.dedup_decisions(points, found_pairs, t["merge_strategy"], t["min_duplicate_score"]))
        points = grouping.apply_decisions(points, decisions)
    if secondary_points is not None:
        s = config["secondary_detection"]
        extra = pairs.secondary_only(points, secondary_points, s["kinetic_dedupe_max_overlap_distance_px"], s["kinetic_dedupe_min_overlap_frames"], s["kinetic_dedupe_min_overlap_ratio"])
        points = points.unionByName(extra.select(*points.columns))
    if region is not None:
        points = regions.exclude_directions(points, regions.full_directions(regions.flag_in_region(points, region), regions.region_centre(region), float(size[1])))
    points, out = written(points), config["output"]
    fast = heated = None
    if config["fast_events"]["enabled"]:
        fast = written(fast_events.both_passes(merged, assessments, {k: w for k, w in config["fast_events"].items() if k != "enabled"}, fps, float(size[1])))
    if fast is not None and frames is not None and h["enabled"]:
        heated = layers.heatmap_events(fast, frames, None, h["threshold"], h["padding_frames"], h["percentile"], h["corridor_width"], max(3, h["bins"]) - 1, h["min_points"], h["min_displacement"], h["first_event_id"], h["max_events"], h["seed_y_min"], h["y_max"])
    trails, ft = None, config["flight_trails"]
    if ft["enabled"]:
        trails = windows.coherent_trails(
            points, max(2, ft["history_frames"]), max(1, ft["max_track_gap_frames"]), max(2, ft["min_history_points"]), ft["min_recent_path_length_px"], ft["min_recent_displacement_px"],
            ft["min_recent_straightness"], ft["stationary_radius_px"], ft["min_segment_displacement_px"],
        )
    shown = points
    if out["trajectory_smoothing_enabled"]:
        s = windows.smooth(points, out["trajectory_smoothing_window"])
        shown = s.withColumns({"x": F.col("x_s"), "y": F.col("y_s")}).drop("x_s", "y_s")
    return Run(raw_points, merged, merges, assessments, points, decisions, found_pairs, rescues, summary.summarise(shown), fast, summary.run_metrics(points), heated, background, region, found_zones, scores, trails)
