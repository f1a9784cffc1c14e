"""Settings: documented defaults by section, merged with a mapping (or a YAML or
JSON file) and checked before a plan is made."""

from __future__ import annotations

import copy
import json
from pathlib import Path

#: The documented default of every setting, of those for drawings and live trails too, which no batch plan reads.
DEFAULTS: dict[str, dict] = {
    "background": {"sample_frames": 200, "uniform_sampling": True, "context_start_sec": 0.0, "context_duration_sec": -1.0},
    "detection": {"blur_kernel": 5, "threshold_mode": "otsu", "diff_threshold": 18, "otsu_offset": -4, "adaptive_block_size": 51, "adaptive_c": -5.0, "centroid_mode": "bbox", "morph_open": 1, "morph_close": 3, "min_area": 6, "max_area": 5000, "max_global_intensity_shift": -1.0, "max_foreground_ratio": -1.0, "max_detections_per_frame": 0, "roi_x_min": -1.0, "roi_x_max": -1.0, "roi_y_min": -1.0, "roi_y_max": -1.0, "temporal_burst_min_detections": 0, "temporal_burst_window_frames": 0, "temporal_burst_trigger_frames": 0, "temporal_burst_cooldown_frames": 0},
    "secondary_detection": {"enabled": False, "algorithm": "foreground", "inherit_primary": True, "dedupe_max_distance_px": 8.0, "dedupe_min_iou": 0.10, "kinetic_dedupe_max_overlap_distance_px": 45.0, "kinetic_dedupe_min_overlap_frames": 4, "kinetic_dedupe_min_overlap_ratio": 0.6},
    "tracking": {"tracker": "kalman", "kalman_sigma_acc": 3.0, "kalman_measurement_std": 2.0, "kalman_high_area_threshold": 0.0, "max_distance": 60.0, "max_missed": 12, "min_track_length": 1, "min_track_duration_sec": 0.0, "min_track_displacement": 12.0, "min_track_path_length": 18.0, "min_track_straightness": 0.0, "auto_scale_with_resolution": False, "reference_width": 1024, "reference_height": 576, "static_noise_filter_enabled": True, "static_noise_min_duration_sec": 3.0, "static_noise_max_mean_speed_ratio_per_sec": 0.025, "static_noise_max_displacement_ratio_per_sec": 0.020, "static_noise_min_static_fraction": 0.0, "static_noise_static_step_ratio_per_frame": 0.0005, "max_track_internal_gap_frames": 45, "loiter_filter_enabled": True, "loiter_min_duration_sec": 10.0, "loiter_min_displacement_ratio": 0.20, "require_start_or_end_in_valid_region": False, "entry_exit_zone_source": "auto", "valid_region_mode": "annotate", "valid_region_gate_dilate_px": 0, "auto_merge_suggested": False, "merge_max_gap_frames": 8, "merge_max_endpoint_distance": 80.0, "merge_overlap_min_common_frames": 3, "merge_overlap_max_mean_distance": 60.0, "merge_overlap_min_direction_cosine": 0.8, "merge_overlap_proximity_override_distance": 0.0, "merge_max_group_overlap_frames": 6, "merge_duplicate_max_distance": 12.0, "merge_max_group_size": 6, "dedupe_coexisting_tracks": False, "rescue_crossing_continuations": False, "enable_track_deduplication": False, "max_spatial_distance_px": 16.0, "max_temporal_gap_frames": 8, "min_direction_similarity": 0.75, "min_speed_similarity": 0.50, "min_duplicate_score": 0.75, "merge_strategy": "mark", "rescue_motion_candidates": False, "rescue_motion_reject_reasons": "valid_region_gate;vegetation_mask", "rescue_motion_min_points": 3, "rescue_motion_min_displacement": 18.0, "rescue_motion_min_path_length": 24.0, "rescue_motion_min_mean_speed": 120.0, "rescue_motion_min_straightness": 0.0, "rescue_motion_interaction_dilate_px": 0},
    "fast_events": {"enabled": False, "order_by_exit_projection": False, "first_event_id": 10001},
    "heatmap_events": {"enabled": False, "first_event_id": 20001, "max_events": 0, "padding_frames": 0, "threshold": 14, "blur_kernel": 5, "percentile": 76.0, "corridor_width": 180.0, "bins": 22, "seed_y_min": -1.0, "y_max": -1.0, "min_points": 6, "min_displacement": 80.0},
    "valid_region": {"enabled": True, "method": "horizontal_illumination_profile", "apply_to_detection": True, "hybrid_combine_mode": "and", "depth_percentile": 85.0, "depth_morph_kernel": 9, "depth_min_area_ratio": 0.02, "depth_layer_percentiles": [], "depth_layer_dilate_px": [], "bottom_contour_snap_enabled": False, "bottom_contour_search_up_px": 18, "bottom_contour_search_down_px": 48, "bottom_contour_smooth_window": 31, "bottom_contour_gradient_quantile": 55.0, "bottom_contour_regularization": 0.90, "bottom_contour_max_step_px": 10, "bottom_contour_downward_bias": 0.10, "bottom_contour_regularization_mix": 0.75, "bottom_contour_deepest_strong_ratio": 0.70, "blur_kernel_size": 151, "profile_smooth_window": 31, "threshold_ratio": 0.45, "safety_margin": 10, "min_region_width_ratio": 0.35, "context_start_sec": -1.0, "context_duration_sec": -1.0},
    "cave_zones": {"enabled": True, "method": "hybrid", "min_component_area_ratio": 0.002, "max_components": 3, "dilate_px": 8, "motion_percentile": 94.0, "dark_percentile": 18.0, "motion_dark_connect_dilate_px": 18},
    "vegetation_noise": {"enabled": False, "auto_scale_with_resolution": True, "reference_width": 1024, "reference_height": 576, "mask_dilate_px": 0, "exclude_entry_exit_zones": True, "exclude_entry_exit_dilate_px": 12, "entry_exit_exclusion_mode": "weak_evidence", "entry_exit_keep_texture_percentile": 88.0, "entry_exit_keep_min_intensity_percentile": 35.0, "entry_exit_keep_min_gradient": 4.0, "auto_sample_frames": 220, "auto_max_frame_for_sampling": 1250, "drop_all_points_in_mask": False, "auto_percentile": 85.0, "auto_min_component_area": 24, "min_motion_ratio_per_sec": 0.25, "min_consecutive_points": 3},
    "flight_trails": {"enabled": False, "history_frames": 12, "max_track_gap_frames": 2, "decay": 0.90, "min_history_points": 3, "min_segment_displacement_px": 4.0, "min_recent_displacement_px": 10.0, "min_recent_path_length_px": 14.0, "min_recent_straightness": 0.20, "stationary_radius_px": 14.0},
    "output": {"trajectory_smoothing_enabled": False, "trajectory_smoothing_window": 5, "export_track_clips": False, "track_clips_padding_frames": 0},
}

#: Settings with a closed set of values.
CHOICES = {
    ("detection", "threshold_mode"): ("fixed", "otsu", "adaptive"), ("detection", "centroid_mode"): ("bbox", "moments"), ("tracking", "tracker"): ("greedy", "kalman"), ("tracking", "valid_region_mode"): ("gate", "annotate"),
    ("tracking", "entry_exit_zone_source"): ("auto", "cave_zones", "cavemark", "valid_region"), ("tracking", "merge_strategy"): ("mark", "discard", "merge", "auto"), ("valid_region", "method"): ("horizontal_illumination_profile", "central_deep_layer", "hybrid_deep_layer_profile"), ("cave_zones", "method"): ("hybrid", "annotation", "motion", "dark"), ("secondary_detection", "algorithm"): ("foreground", "kinetic"),
}
UNIT = [("tracking", "min_direction_similarity"), ("tracking", "min_speed_similarity"), ("tracking", "min_duplicate_score"), ("cave_zones", "min_component_area_ratio"), ("secondary_detection", "dedupe_min_iou")]
ODD = {("output", "trajectory_smoothing_window"): 3, ("valid_region", "blur_kernel_size"): 1, ("valid_region", "profile_smooth_window"): 1}
#: Control keys of the secondary detection that its detection settings do not take over.
SECONDARY_CONTROL = ("enabled", "algorithm", "inherit_primary", "dedupe_max_distance_px", "dedupe_min_iou")


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, section by section; unknown keys pass."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(source: dict | str | Path | None = None) -> dict:
    """Checked settings from a mapping, or a JSON (or, where a parser is there, YAML) file."""
    if source is None:
        own = {}
    elif isinstance(source, dict):
        own = source
    else:
        text = Path(source).read_text(encoding="utf-8")
        try:
            own = json.loads(text)
        except ValueError:
            import yaml

            own = yaml.safe_load(text) or {}
    if not isinstance(own, dict):
        raise ValueError("settings must be a mapping of sections")
    config = merged(DEFAULTS, own)
    check(config)
    return config


def check(config: dict) -> None:
    """ValueError for a setting outside its values."""
    for section in DEFAULTS:
        if not isinstance(config.get(section, {}), dict):
            raise ValueError(f"{section} must be a mapping")
    for (section, key), values in CHOICES.items():
        if str(config[section][key]).strip().lower() not in values:
            raise ValueError(f"{section}.{key} must be one of {'/'.join(values)}, got {config[section][key]}")
    for section, key in UNIT:
        if not 0 <= float(config[section][key]) <= 1:
            raise ValueError(f"{section}.{key} must lie between 0 and 1, got {config[section][key]}")
    for (section, key), least in ODD.items():
        if int(config[section][key]) < least or int(config[section][key]) % 2 == 0:
            raise ValueError(f"{section}.{key} must be odd and {least} at least, got {config[section][key]}")
    for section, start in (("background", 0.0), ("valid_region", -1.0)):
        c = config[section]
        if float(c["context_start_sec"]) < start:
            raise ValueError(f"{section}.context_start_sec must be {start:g} at least, got {c['context_start_sec']}")
        if float(c["context_duration_sec"]) == 0 or float(c["context_duration_sec"]) < -1:
            raise ValueError(f"{section}.context_duration_sec must be above 0, or -1 for the whole, got {c['context_duration_sec']}")
    if float(config["tracking"]["max_spatial_distance_px"]) <= 0:
        raise ValueError("tracking.max_spatial_distance_px must be above 0")
    if int(config["tracking"]["max_temporal_gap_frames"]) < 0:
        raise ValueError("tracking.max_temporal_gap_frames must not be negative")
    if int(config["cave_zones"]["max_components"]) < 1:
        raise ValueError("cave_zones.max_components must be 1 at least")
    if float(config["secondary_detection"]["dedupe_max_distance_px"]) < 0:
        raise ValueError("secondary_detection.dedupe_max_distance_px must not be negative")


def context_frames(config: dict, section: str, fps: float, frame_count: int) -> tuple[int, int]:
    """[start, end) of a section's context in frames; the valid region takes over what it leaves open (-1)."""
    own, base = config[section], config["background"]
    start = own["context_start_sec"] if own["context_start_sec"] >= 0 else base["context_start_sec"]
    length = own["context_duration_sec"] if own["context_duration_sec"] > 0 else (base["context_duration_sec"] if section != "background" else -1)
    first = min(max(0, int(round(start * fps))), max(0, frame_count - 1))
    return first, frame_count if length <= 0 else min(frame_count, first + max(1, int(round(length * fps))))


def context_seconds(config: dict, section: str) -> tuple[float, float]:
    """Start and length in seconds of a section's context; the valid region takes over what it leaves open (-1); a length of 0 or less is open."""
    own, base = config[section], config["background"]
    start = own["context_start_sec"] if own["context_start_sec"] >= 0 else base["context_start_sec"]
    length = own["context_duration_sec"] if own["context_duration_sec"] > 0 else (base["context_duration_sec"] if section != "background" else -1)
    return start, length


def secondary_detection(primary: dict, secondary: dict) -> dict:
    """Detection settings of the second pass: its own over the first one's, less what controls it."""
    own = {k: v for k, v in secondary.items() if k not in SECONDARY_CONTROL and not k.startswith("kinetic_")}
    return (primary | own) if secondary.get("inherit_primary", True) else own


def odd(value: int, least: int = 1) -> int:
    value = max(least, int(value))
    return value if value % 2 else value + 1


def number_list(value, kind=int) -> list:
    """A list of numbers from a list, one number or a comma or semicolon text."""
    if value is None or value == "":
        return []
    if isinstance(value, str):
        value = value.replace(";", ",").split(",")
    return [kind(v) for v in value if str(v).strip()] if isinstance(value, (list, tuple)) else [kind(value)]
