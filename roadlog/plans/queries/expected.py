"""Anchors and metrics of every use case once more, as SQL with the limits written out: what the catalogue is checked against.

Nothing here is taken from the catalogue, so a wrong rule or limit in it shows as a differing verdict.
"""

from __future__ import annotations

from . import metric_sql as q

# fixed values: limits of the tests in m/s, m, ft and s
STEADY_30 = "speed BETWEEN 12.51712 AND 14.30528"
STEADY_35 = "speed BETWEEN 13.85824 AND 17.43456"
GAP = "actual_gap / desired_gap * 2.5"
NEAR_START, NEAR_END = "speed >= 0.9 * 13.4112", "speed <= 1.1 * 8.9408"
SIDE = "CASE WHEN list_contains(right_lanes, lanelet_id) THEN 'right' WHEN list_contains(middle_lanes, lanelet_id) THEN 'middle' END"
CHANGERS = ["UnobstructedLaneChangePlugin", "CooperativeLaneChangePlugin"]
WHOLE = ("start", "finish")


def _a(name, kind, view, where, **more):
    return {"name": name, "kind": kind, "view": view, "where": where, **more}


_ENGAGED = [_a("start", "first", "state", "state = 4"), _a("finish", "leave", "state", "state = 4")]
_FENCE = [_a("enter", "first", "geofence", "is_on"), _a("exit", "leave", "geofence", "is_on"), _a("first_control", "first", "control", "choice > 0")]
_TALK = [_a("asked", "first", "request_out", "plan_type = 1"), _a("accepted", "first", "response_in", "accepted", after="asked"),
         _a("asked_again", "first", "request_out", "plan_type = 2", after="accepted"), _a("joined", "first", "response_in", "accepted", after="asked_again")]
_FASTER = [_a("faster", "moves", "twist", "speed", after="exit", k=5, sign=1, at="start")]

ANCHORS = {
    "basic_travel": _ENGAGED + _FENCE + _TALK + _FASTER,
    "work_zone": _ENGAGED + _FENCE + [
        _a("stopped", "first", "twist", "speed < 0.3", after="start"), _a("green", "first", "spat", "phase = 6", after="stopped"),
        _a("at_bar", "first", "pose", "sqrt((x - stop_x) ** 2 + (y - stop_y) ** 2) <= 1.0", after="start")],
    "freight_work_zone": _ENGAGED + _FENCE + [
        _a("slow_limit", "first", "route_state", "speed_limit BETWEEN 8.8908 AND 8.9908", after="start", until="finish"),
        _a("full_limit", "first", "route_state", "speed_limit BETWEEN 13.3612 AND 13.4612", after="slow_limit", until="finish"),
        _a("slower", "moves", "twist", "speed", after="slow_limit", until="finish", k=10, sign=-1, at="kth"),
        _a("faster", "moves", "twist", "speed", after="full_limit", until="finish", k=20, sign=1, at="base"),
        _a("at_speed", "first", "twist", "speed >= 12.5212", after="faster")],
    "freight_emergency": _ENGAGED + [
        _a("siren_on", "first", "bsm", "siren AND light"), _a("detected", "first", "erv", "detected", after="siren_on"),
        _a("attempt", "first", "erv", "action = 'Attempting'", after="start"), _a("planned", "first", "maneuver", "type = 1", after="attempt"),
        _a("other_lane", "switch", "route_state", SIDE, after="start"), _a("lane_taken", "switch", "route_state", "lanelet_id", after="other_lane"),
        _a("slowed", "first", "twist", "speed <= 7.8232", after="lane_taken", until="finish"),
        _a("faster", "moves", "twist", "speed", after="slowed", until="finish", k=20, sign=1, at="kth"),
        _a("at_speed", "first", "twist", "speed >= 14.5288", after="faster", until="finish"),
        _a("hazard", "first", "erv", "action = 'possible.'", after="start", until="finish"),
        _a("warned", "first", "warning", "t >= 0", after="start", until="finish"), _a("hazard_ack", "first", "ack", "part >= 0", after="start", until="finish")],
    "traffic_incident": _ENGAGED + _FENCE + _FASTER,
    "platooning": _ENGAGED + _TALK,
    "port_drayage": _ENGAGED + [
        _a("completed", "first", "route_event", "event = 3", after="start"), _a("arrival", "first", "op_out", "operation = 'PICKUP'", after="start"),
        _a("next_goal", "first", "op_in", "operation = 'DROPOFF'", after="arrival"), _a("route_set", "first", "route_event", "event = 2", after="next_goal"),
        _a("stopped", "first", "twist", "speed < 0.3", after="start")],
    "intersection": _ENGAGED,
    "scale_vehicle": [],
}


def _zone(decel, distance, accel, steady, outside, advisory):
    return [
        (decel, q.section("twist", "speed", "speed < 0.9 * 13.4112", NEAR_END, high=-1.0, window=("start", "enter"))),
        (distance, q.moved_feet("faster", "exit", "route_state", "down_track", low=0.0, high=30.0)),
        (accel, q.section("twist", "speed", "speed > 1.1 * 8.9408", NEAR_START, low=1.0, window=("exit", "finish"))),
        (steady, q.held("twist", STEADY_30, 10.0, window=("exit", "finish"))),
        (outside, q.always("route_state", "abs(speed_limit - 13.4112) < 0.01", window=("start", "enter", 0, 0.8))),
        (advisory, q.always("geofence", "abs(advisory - 8.9408) < 0.01", where="is_on")),
    ]


METRICS = {
    "basic_travel": [
        ("B-1", q.route("route", "lanelets", "first", "original_lanes", "contains")),
        ("B-2", q.always("route_state", "abs(speed_limit - 8.9408) < 0.01", window=("enter", "exit", 0, 0.8))),
        ("B-3", q.needed_deceleration("twist", "speed", 8.9408, "first_control", "route_state", "down_track", "enter", 2.0)),
        ("B-5", q.order("route_state", "lanelet_id", "lane_order")),
        ("B-6", q.anchor_gap("accepted", "asked_again", low=0.0)),
        ("B-7", q.anchor_gap("asked", "accepted", low=0.0)),
        ("B-8", q.value_at("platoon", GAP, "joined", 0.5, 4.5, where="state = 5 AND actual_gap > 0")),
        ("B-9", q.follows("platoon", "state", 3, 5, window=("accepted", None))),
        ("B-10", q.follows("platoon", "state", 2, 4, window=("accepted", None))),
        ("B-11", q.always("platoon", f"{GAP} BETWEEN 2.0 AND 3.0", window=("joined", "finish"))),
        ("B-12", q.gap_share("op_out", 0.2, 90.0, "strategy = 'STATUS'", ("accepted", None))),
        ("B-24", q.gap_share("op_in", 0.5, 90.0, "strategy = 'INFO'", ("accepted", None))),
        *_zone("B-13", "B-14", "B-15", "B-16", "B-17", "B-18"),
        ("B-19", q.exists("control", "choice = 12")),
        ("B-20", q.time_share("route_state", "abs(cross_track) <= 0.5", 95.0, WHOLE)),
        ("B-22", q.never("route_state", "abs(cross_track) > 0.6", window=WHOLE)),
        ("B-25", q.settle("platoon", f"{GAP} BETWEEN 2.0 AND 3.0", 10.0, ("joined", "enter"), where="state = 5")),
        ("B-26", q.gap_max("op_out", 1.0, "strategy = 'STATUS'", ("accepted", None))),
        ("B-27", q.gap_max("op_in", 1.0, "strategy = 'INFO'", ("accepted", None))),
        ("negotiation", q.anchor_gap("asked", "joined", low=0.0)),
    ],
    "work_zone": [
        ("WZ-1", q.route("route", "lanelets", "first", "original_lanes", "contains")),
        ("WZ-reroute", q.route("route", "lanelets", "last", "closed_lanes", "avoids")),
        ("WZ-2", q.steady_before("twist", STEADY_30, "first_control", 10.0, "start")),
        ("WZ-4", q.exists("control", "choice = 5 AND closed = 1")),
        ("WZ-5", q.exists("control", "choice = 7")),
        ("WZ-6", q.exists("control", "choice = 12")),
        ("WZ-7", q.exists("control", "choice = 13")),
        ("WZ-8", q.exists("control", "choice = 5 AND closed = 2")),
        ("WZ-9", q.gap_share("spat", 0.5, 90.0, window=WHOLE)),
        ("WZ-10", q.gap_max("spat", 1.0, window=WHOLE)),
        ("WZ-11", q.section("twist", "speed", NEAR_START, "speed < 0.3", high=-1.0, window=("start", "stopped"))),
        ("WZ-11-second", q.second_rate("twist", "speed", 2.0, ("start", "stopped"))),
        ("WZ-12", q.stop_short("pose", "x", "y", "stop_x", "stop_y", "bumper", "stopped", "start", 15.0)),
        ("WZ-13", q.wait("green", "twist", "speed > 0.1", 4.0)),
        ("WZ-14", q.section("twist", "speed", "speed > 0.5", NEAR_START, low=1.0, window=("green", "finish"))),
        ("WZ-15", q.value_at("twist", "speed", "at_bar", 8.04672, 9.83488)),
        ("WZ-15-phase", q.value_at("spat", "phase", "at_bar", 6, 6)),
        ("WZ-16", q.second_rate("twist", "speed", 2.0, ("start", "enter"))),
        ("WZ-23", q.steady_to("twist", "speed BETWEEN 8.0468 AND 9.8348", "finish", 10, 3.0)),
        ("WZ-24", q.value_at("route_state", "speed_limit", "start", 8.9308, 8.9508)),
        ("WZ-25", q.value_gap("geofence", "advisory", "enter", "route_state", "speed_limit", "start", -2.2452, -2.2252)),
    ],
    "freight_work_zone": [
        ("FWZ-1", q.route("route", "lanelets", "first", "original_lanes", "contains")),
        ("FWZ-8", q.route("route", "lanelets", "last", "closed_lanes", "avoids")),
        ("FWZ-2", q.steady_before("twist", STEADY_30, "first_control", 5.0, "start")),
        ("FWZ-7", q.always("route_state", "abs(speed_limit - 8.9408) < 0.03", window=("enter", "exit", 2.0, 2.0))),
        ("FWZ-9", q.exists("control", "choice = 5")),
        ("FWZ-10", q.acked("control", "part", "ack", 1.0)),
        ("FWZ-10-parts", q.complete("ack", "part", 3)),
        ("FWZ-12", q.paired_wait("control", "route", 3.0)),
        ("FWZ-15", q.interval_length("trajectory", "planner = ''", 5.0, WHOLE)),
        ("FWZ-23", q.begins_within("twist", "speed", -1, 10, ("slow_limit", "finish"), below=1.3)),
        ("FWZ-24", q.value_at("twist", "speed", "enter", 8.04672, 9.83488)),
        ("FWZ-25", q.section("twist", "speed", "speed IS NOT NULL", "speed <= 10.0584", low=-2.0, window=("slower", None))),
        ("FWZ-26", q.begins_within("twist", "speed", 1, 20, ("full_limit", "finish"), seconds=10.0)),
        ("FWZ-27", q.section("twist", "speed", "speed IS NOT NULL", "speed >= 12.5212", low=0.0, window=("faster", None))),
        ("FWZ-27-second", q.second_rate("twist", "speed", 1.5, ("faster", "at_speed"), signed=True)),
        ("FWZ-29", q.held("twist", STEADY_30, 5.0, ("exit", "finish"))),
        ("FWZ-32", q.paired_wait("request_out", "control", 1.0)),
    ],
    "freight_emergency": [
        ("FER-1", q.window_frequency("bsm", 5.0, 7.95)),
        ("FER-2", q.steady_before("twist", STEADY_35, "detected", 5.0, "start")),
        ("FER-3", q.time_share("twist", STEADY_35, 90.0, ("start", "detected"))),
        ("FER-4", q.exists("bsm", "NOT part2")),
        ("FER-5", q.window_frequency("bsm", 5.0, 7.95, window=("start", None))),
        ("FER-8", q.exists("bsm", "part2 AND siren AND light")),
        ("FER-9", q.mean_frequency("bsm", 8.0, "siren AND light", ("start", None))),
        ("FER-10", q.anchor_gap("siren_on", "detected", high=1.0)),
        ("FER-11", q.exists_as("erv", "detected", "opposing")),
        ("FER-12", q.never("erv", "detected AND action = 'Opposing'")),
        ("FER-14", q.exists("erv", "action = 'Attempting'", window=("start", None))),
        ("FER-15", q.anchor_gap("attempt", "planned", high=1.05)),
        ("FER-16", q.wait("planned", "trajectory", "planner = ''", 0.25)),
        ("FER-22", q.both("route_state", "list_contains(right_lanes, lanelet_id)", "list_contains(middle_lanes, lanelet_id) AND NOT list_contains(right_lanes, lanelet_id)", window=("start", None))),
        ("FER-23", q.lane_speed("route_state", "cross_track", SIDE, "other_lane", "lane_taken", "start", 0.5, 1.25)),
        ("FER-26", q.row_run("twist", "speed < 7.8232", 10, ("lane_taken", "finish"))),
        ("FER-27", q.section("twist", "speed", "speed IS NOT NULL", "speed <= 7.8232", low=-1.05, window=("lane_taken", "finish"))),
        ("FER-27-second", q.second_rate("twist", "speed", 2.05, ("lane_taken", "finish"))),
        ("FER-28", q.exists("erv", "passing > 10", window=("slowed", "finish"))),
        ("FER-29", q.both("maneuver", "type = 1 AND list_contains(middle_lanes, start_lane) AND list_contains(right_lanes, end_lane)",
                          "type = 1 AND list_contains(right_lanes, start_lane) AND list_contains(middle_lanes, end_lane)", window=("attempt", None))),
        ("FER-30", q.section("twist", "speed", "speed IS NOT NULL", "speed >= 14.5288", high=1.05, window=("faster", "finish"))),
        ("FER-30-second", q.second_rate("twist", "speed", 2.05, ("faster", "at_speed"))),
        ("FER-32", q.anchor_gap("hazard", "warned", -0.1, 0.1)),
        ("FER-33", q.row_run("twist", "speed < 7.8232", 10, ("hazard", "finish"))),
        ("FER-34", q.anchor_gap("warned", "hazard_ack", high=1.0)),
        ("FER-35", q.count_limit("warning", "t >= 0", 10, window=WHOLE)),
        ("FER-35-after", q.none_after("warning", "t >= 0", "hazard_ack", 0.1, "finish")),
    ],
    "traffic_incident": [
        ("TIM-1", q.route("route", "lanelets", "first", "original_lanes", "contains")),
        ("TIM-11", q.route("route", "lanelets", "last", "closed_lanes", "avoids")),
        ("TIM-2", q.steady_before("twist", STEADY_30, "first_control", 10.0, "start")),
        ("TIM-10", q.always("route_state", "abs(speed_limit - 8.9408) < 0.01", window=("enter", "exit", 0, 0.8))),
        ("TIM-28", q.exists("control", "choice = 12 AND abs(maxspeed - 8.9408) < 0.01")),
        ("TIM-13", q.merge_end("plan_points", "plan", "target", "planner", CHANGERS, "x", "y", ("start", "enter"), "pose", 0.0, 50.0)),
        ("TIM-20", q.merge_start("plan_points", "planner", CHANGERS, "x", "y", "exit", "pose", 0.0, 30.0)),
        *_zone("TIM-15", "TIM-21", "TIM-22", "TIM-23", "TIM-24", "TIM-25"),
    ],
    "platooning": [
        ("formation", q.anchor_gap("asked", "joined", 0.0, 2.0)),
        ("control-parts", q.complete("control", "part", 3, window=("asked", None))),
        ("cross-track", q.always("route_state", "abs(cross_track) < 1.5", window=("joined", "finish"))),
        ("distance", q.value_at("platoon", "actual_gap", "joined", high=90.0)),
        ("time-gap", q.value_at("platoon", GAP, "joined", high=15.0)),
        ("limit-changes", q.hysteresis_count("route_state", "speed_limit", 0.1, 1, None)),
    ],
    "port_drayage": [
        ("PD-1", q.exists("twist", STEADY_30, window=WHOLE)),
        ("PD-4", q.listed("route_state", "lanelet_id", "speed_limit BETWEEN 8.94 AND 11.18", "port_order", WHOLE)),
        ("PD-19", q.always("route_state", "abs(speed_limit - 8.9408) < 0.5", "lanelet_id < port_lane", WHOLE)),
        ("PD-23", q.section("twist", "speed", "speed > 0.1", NEAR_START, low=1.0, window=WHOLE)),
        ("PD-23-second", q.second_rate("twist", "speed", 2.0, WHOLE)),
        ("PD-24", q.section("twist", "speed", NEAR_START, "speed < 0.3", high=-1.0, window=("start", "completed"))),
        ("PD-24-second", q.second_rate("twist", "speed", 2.0, ("start", "completed"))),
        ("PD-25", q.wait("completed", "op_out", "operation IS NOT NULL", 3.0)),
        ("PD-18", q.exists("op_out", "operation = 'PICKUP'", window=("start", None))),
        ("PD-9", q.exists("op_in", "operation = 'DROPOFF'", window=("arrival", None))),
        ("PD-20", q.exists("op_in", "operation = 'DROPOFF'", window=("arrival", None))),
        ("PD-10", q.wait("next_goal", "ui", "popup", 5.0)),
        ("PD-21", q.anchor_gap("arrival", "next_goal", below=1.5)),
        ("PD-22", q.anchor_gap("next_goal", "route_set", below=3.0)),
        ("PD-2", q.value_at("pose", "sqrt((x - stop_x) ** 2 + (y - stop_y) ** 2) - stop_offset", "stopped", high=3.0)),
        ("PD-11", q.value_at("pose", "sqrt((x - stop_x) ** 2 + (y - stop_y) ** 2) - stop_offset", "stopped", high=10.0)),
    ],
    "intersection": [
        ("M1.2-signal", q.window_band("spat", 1.0, 9.0, 11.0, window=WHOLE)),
        ("M1.2-map", q.window_band("map", 5.0, 0.5, 1.5, window=WHOLE)),
        ("M2.1", q.order("route_state", "lanelet_id", "lane_order", WHOLE)),
        ("M2.3", q.never("entry", "lanelet_id = right_lane AND phase <> 6", window=WHOLE)),
        ("M2.5", q.second_rate("twist", "speed", 3.0, WHOLE)),
    ],
    "scale_vehicle": [
        ("SV-01", q.paired_wait("call", "plan", 3.0)),
        ("SV-02", q.exists("plan", "t >= 0")),
        ("SV-03", q.always("route_state", "abs(cross_track) < 0.3")),
        ("SV-03-share", q.time_share("route_state", "abs(cross_track) < 0.2", 95.0)),
        ("SV-05", q.plateau_error("speed_target", "speed", "target", 0.2, 1)),
        ("SV-06", q.turn_speed("speed_target", "speed", "target", 0.5)),
        ("SV-07", q.arrival_distance("ops", "side = 'goal'", "side = 'ack'", "x", "y", 0.5)),
        ("SV-08", q.exists("op_out", "t >= 0")),
        ("SV-09", q.exists("op_in", "t >= 0")),
        ("SV-10", q.paired_wait("op_in", "plan", 3.0)),
        ("SV-13", q.acked("op_in", "operation", "op_out", 60.0, where="operation IN ('PICKUP', 'DROPOFF')")),
        ("SV-14", q.exists("op_out", "operation = 'PORT_CHECKPOINT'")),
        ("SV-17", q.acked("op_in", "operation", "op_out", 60.0, where="operation = 'HOLDING_AREA'")),
    ],
}
