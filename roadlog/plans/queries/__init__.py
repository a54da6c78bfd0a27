"""The registered queries, by family."""

from . import aggregates, files, joins, logs, metrics, reshape, space, streams, windows  # noqa: F401
from ..registry import cut_twin

# queries whose operators work otherwise on recordings over the row budget; the twins show that both ways agree
CUT = [
    "gap_coverage", "state_intervals", "longest_band_run", "consecutive_increase", "resetting_sum", "rolling_mean_full",
    "moving_average_centered", "trailing_mean", "sliding_frequency", "unwrap", "gradient", "path_length", "settle_time", "ordered_sequence",
    "debounced_plateau", "asof_backward", "asof_nearest", "last_known_merge", "ordinal_pairing", "fifo_match", "fifo_match_bounded",
    "hysteresis_changes", "drop_repeats", "interval_join", "group_stats", "describe", "box_numbers", "series_stats", "resample_linear", "interpolate_at",
    "segment_crossing", "conflict_scan", "nearest_point", "cross_track", "offset_search", "path_reached", "request_chain", "fill_gaps",
    "missing_durations", "message_frequency", "change_points", "last_before_code_change", "metrics_work_zone",
    "zone_times", "sensor_accuracy", "anchored_windows",
]
for _name in CUT:
    cut_twin(_name, 20)
