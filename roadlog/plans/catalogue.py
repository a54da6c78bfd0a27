"""The metrics of every use case, as rules with their thresholds.

Views and fields: state(state), route_state(lanelet_id, cross_track, down_track, speed_limit),
route(lanelets), route_event(event), geofence(is_on, advisory), twist(speed), platoon(state,
actual_gap, desired_gap), op_in and op_out(strategy, operation), request_out, response_in
(plan_type, accepted), control(choice, closed, maxspeed, msgnum, part), ack(part), spat(phase),
bsm(siren, light, part2), erv(detected, action, passing in s), maneuver(type, start_lane, end_lane), trajectory(planner),
plan_points (a row per point of a planned trajectory: plan, target in ns, x, y, planner), pose(x, y),
speed_target(speed, target), call and plan (empty), warning (one that says lanes cannot be changed), ui(popup).

What differs from run to run is no constant here but a column of the run manifest: original_lanes,
closed_lanes, lane_order, port_order, right_lanes and middle_lanes (lists of lanelets), right_lane and port_lane (the lanelet at a
signal, and that behind the port), bumper (from the point of the pose to the front), stop_x, stop_y and stop_offset (the goal of a stop in the map and the
distance from it to the reported point), opposing (whether the emergency vehicle comes the other way).
"""

from __future__ import annotations

from .metrics import Anchor, Metric, UseCase

# fixed values: speeds in m/s, distances in m or ft, times in s
ENGAGED = "state = 4"
ORIGINAL_LIMIT, ADVISORY_LIMIT, MPH_2 = 13.4112, 8.9408, 0.89408
HALF_LANE, OVER_LINE = 0.5, 0.1
NEAR_ADVISORY = f"speed <= 1.1 * {ADVISORY_LIMIT}"
NEAR_LIMIT = f"speed >= 0.9 * {ORIGINAL_LIMIT}"
TIME_GAP = "actual_gap / desired_gap * 2.5"
STEADY = f"speed BETWEEN {ORIGINAL_LIMIT - MPH_2} AND {ORIGINAL_LIMIT + MPH_2}"

ENGAGEMENT = (
    Anchor("start", "first", "state", ENGAGED),
    Anchor("finish", "leave", "state", ENGAGED),
)
FENCE = (
    Anchor("enter", "first", "geofence", "is_on"),
    Anchor("exit", "leave", "geofence", "is_on"),
)
CONTROL = (Anchor("first_control", "first", "control", "choice > 0"),)
PLATOON = (
    Anchor("asked", "first", "request_out", "plan_type = 1"),
    Anchor("accepted", "first", "response_in", "accepted", after="asked"),
    Anchor("asked_again", "first", "request_out", "plan_type = 2", after="accepted"),
    Anchor("joined", "first", "response_in", "accepted", after="asked_again"),
)


LANE = "CASE WHEN array_contains(right_lanes, lanelet_id) THEN 'right' WHEN array_contains(middle_lanes, lanelet_id) THEN 'middle' END"
HAZARD_SPEED = 6.7056 + 1.1176
FREIGHT_LIMIT, FREIGHT_BAND = 15.6464, 1.78816
FREIGHT_STEADY = f"speed BETWEEN {FREIGHT_LIMIT - FREIGHT_BAND} AND {FREIGHT_LIMIT + FREIGHT_BAND}"
MERGING = ["UnobstructedLaneChangePlugin", "CooperativeLaneChangePlugin"]


def _faster(sign: int = 1) -> Anchor:
    """The first of five rises of the speed in a row after the zone."""
    return Anchor("faster", "moves", "twist", "speed", after="exit", k=5, sign=sign, at="start")


def _driving(accel: str, distance: str, steady: str, outside: str, advisory: str, decel: str) -> tuple[Metric, ...]:
    """The speed metrics around a slow zone that several use cases share."""
    return (
        Metric(decel, "section", {"view": "twist", "value": "speed", "begins": f"speed < 0.9 * {ORIGINAL_LIMIT}", "ends": NEAR_ADVISORY, "high": -1.0,
                                  "window": ("start", "enter")}, "mean deceleration of at least 1 m/s2 before the zone"),
        Metric(distance, "moved_feet", {"at": "faster", "since": "exit", "place_view": "route_state", "place": "down_track", "low": 0.0, "high": 30.0},
               "acceleration starts within 30 ft after the zone"),
        Metric(accel, "section", {"view": "twist", "value": "speed", "begins": f"speed > 1.1 * {ADVISORY_LIMIT}", "ends": NEAR_LIMIT, "low": 1.0,
                                  "window": ("exit", "finish")}, "mean acceleration of at least 1 m/s2 after the zone"),
        Metric(steady, "held", {"view": "twist", "holds": STEADY, "seconds": 10.0, "window": ("exit", "finish")}, "steady for 10 s after the zone"),
        Metric(outside, "always", {"view": "route_state", "holds": f"abs(speed_limit - {ORIGINAL_LIMIT}) < 0.01", "window": ("start", "enter", 0, 0.8)},
               "original limit outside of the zone"),
        Metric(advisory, "always", {"view": "geofence", "holds": f"abs(advisory - {ADVISORY_LIMIT}) < 0.01", "where": "is_on"}, "advisory is the limit less 10 mph"),
    )


BASIC_TRAVEL = UseCase("basic_travel", ENGAGEMENT + FENCE + CONTROL + PLATOON + (_faster(),), (
    Metric("B-1", "route", {"view": "route", "column": "lanelets", "which": "first", "members": "original_lanes", "relation": "contains"}),
    Metric("B-2", "always", {"view": "route_state", "holds": f"abs(speed_limit - {ADVISORY_LIMIT}) < 0.01", "window": ("enter", "exit", 0, 0.8)}),
    Metric("B-3", "needed_deceleration", {"view": "twist", "value": "speed", "target": ADVISORY_LIMIT, "at": "first_control",
                                          "place_view": "route_state", "place": "down_track", "to": "enter", "limit": 2.0}),
    Metric("B-5", "order", {"view": "route_state", "column": "lanelet_id", "values": "lane_order"}),
    Metric("B-6", "anchor_gap", {"first": "accepted", "second": "asked_again", "low": 0.0}),
    Metric("B-7", "anchor_gap", {"first": "asked", "second": "accepted", "low": 0.0}),
    Metric("B-8", "value_at", {"view": "platoon", "value": TIME_GAP, "at": "joined", "low": 0.5, "high": 4.5, "where": "state = 5 AND actual_gap > 0"}),
    Metric("B-9", "follows", {"view": "platoon", "column": "state", "one": 3, "two": 5, "window": ("accepted", None)}),
    Metric("B-10", "follows", {"view": "platoon", "column": "state", "one": 2, "two": 4, "window": ("accepted", None)}),
    Metric("B-11", "always", {"view": "platoon", "holds": f"{TIME_GAP} BETWEEN 2.0 AND 3.0", "window": ("joined", "finish")}),
    Metric("B-12", "gap_share", {"view": "op_out", "limit": 0.2, "share": 90.0, "where": "strategy = 'STATUS'", "window": ("accepted", None)}),
    Metric("B-24", "gap_share", {"view": "op_in", "limit": 0.5, "share": 90.0, "where": "strategy = 'INFO'", "window": ("accepted", None)}),
    *_driving("B-15", "B-14", "B-16", "B-17", "B-18", "B-13"),
    Metric("B-19", "exists", {"view": "control", "holds": "choice = 12"}),
    Metric("B-20", "time_share", {"view": "route_state", "holds": f"abs(cross_track) <= {HALF_LANE}", "share": 95.0, "window": ("start", "finish")}),
    Metric("B-22", "never", {"view": "route_state", "holds": f"abs(cross_track) > {HALF_LANE + OVER_LINE}", "window": ("start", "finish")}),
    Metric("B-25", "settle", {"view": "platoon", "holds": f"{TIME_GAP} BETWEEN 2.0 AND 3.0", "seconds": 10.0, "window": ("joined", "enter"), "where": "state = 5"}),
    Metric("B-26", "gap_max", {"view": "op_out", "limit": 1.0, "where": "strategy = 'STATUS'", "window": ("accepted", None)}),
    Metric("B-27", "gap_max", {"view": "op_in", "limit": 1.0, "where": "strategy = 'INFO'", "window": ("accepted", None)}),
    Metric("negotiation", "anchor_gap", {"first": "asked", "second": "joined", "low": 0.0}),
))

WORK_ZONE = UseCase("work_zone", ENGAGEMENT + FENCE + CONTROL + (
    Anchor("stopped", "first", "twist", "speed < 0.3", after="start"),
    Anchor("green", "first", "spat", "phase = 6", after="stopped"),
    Anchor("at_bar", "first", "pose", "sqrt((x - stop_x) * (x - stop_x) + (y - stop_y) * (y - stop_y)) <= 1.0", after="start"),
), (
    Metric("WZ-1", "route", {"view": "route", "column": "lanelets", "which": "first", "members": "original_lanes", "relation": "contains"}),
    Metric("WZ-reroute", "route", {"view": "route", "column": "lanelets", "which": "last", "members": "closed_lanes", "relation": "avoids"}),
    Metric("WZ-2", "steady_before", {"view": "twist", "holds": STEADY, "event": "first_control", "seconds": 10.0, "begin": "start"}),
    Metric("WZ-4", "exists", {"view": "control", "holds": "choice = 5 AND closed = 1"}),
    Metric("WZ-5", "exists", {"view": "control", "holds": "choice = 7"}),
    Metric("WZ-6", "exists", {"view": "control", "holds": "choice = 12"}),
    Metric("WZ-7", "exists", {"view": "control", "holds": "choice = 13"}),
    Metric("WZ-8", "exists", {"view": "control", "holds": "choice = 5 AND closed = 2"}),
    Metric("WZ-9", "gap_share", {"view": "spat", "limit": 0.5, "share": 90.0, "window": ("start", "finish")}),
    Metric("WZ-10", "gap_max", {"view": "spat", "limit": 1.0, "window": ("start", "finish")}),
    Metric("WZ-11", "section", {"view": "twist", "value": "speed", "begins": NEAR_LIMIT, "ends": "speed < 0.3", "high": -1.0, "window": ("start", "stopped")}),
    Metric("WZ-11-second", "second_rate", {"view": "twist", "value": "speed", "limit": 2.0, "window": ("start", "stopped")}),
    Metric("WZ-12", "stop_short", {"view": "pose", "x": "x", "y": "y", "goal_x": "stop_x", "goal_y": "stop_y", "front": "bumper", "at": "stopped", "start": "start", "limit": 15.0}),
    Metric("WZ-13", "wait", {"since": "green", "view": "twist", "holds": "speed > 0.1", "seconds": 4.0}),
    Metric("WZ-14", "section", {"view": "twist", "value": "speed", "begins": "speed > 0.5", "ends": NEAR_LIMIT, "low": 1.0, "window": ("green", "finish")}),
    Metric("WZ-15", "value_at", {"view": "twist", "value": "speed", "at": "at_bar", "low": ADVISORY_LIMIT - MPH_2, "high": ADVISORY_LIMIT + MPH_2}),
    Metric("WZ-15-phase", "value_at", {"view": "spat", "value": "phase", "at": "at_bar", "low": 6, "high": 6}),
    Metric("WZ-16", "second_rate", {"view": "twist", "value": "speed", "limit": 2.0, "window": ("start", "enter")}),
    Metric("WZ-23", "steady_to", {"view": "twist", "holds": f"speed BETWEEN {ADVISORY_LIMIT - 0.894} AND {ADVISORY_LIMIT + 0.894}", "to": "finish", "last": 10, "seconds": 3.0}),
    Metric("WZ-24", "value_at", {"view": "route_state", "value": "speed_limit", "at": "start", "low": ADVISORY_LIMIT - 0.01, "high": ADVISORY_LIMIT + 0.01}),
    Metric("WZ-25", "value_gap", {"view": "geofence", "value": "advisory", "at": "enter", "other_view": "route_state", "other_value": "speed_limit", "other_at": "start",
                                  "low": -2.2352 - 0.01, "high": -2.2352 + 0.01}),
))

FREIGHT_WORK_ZONE = UseCase("freight_work_zone", ENGAGEMENT + FENCE + CONTROL + (
    Anchor("slow_limit", "first", "route_state", f"abs(speed_limit - {ADVISORY_LIMIT}) <= 0.05", after="start", until="finish"),
    Anchor("full_limit", "first", "route_state", f"abs(speed_limit - {ORIGINAL_LIMIT}) <= 0.05", after="slow_limit", until="finish"),
    Anchor("slower", "moves", "twist", "speed", after="slow_limit", until="finish", k=10, sign=-1, at="kth"),
    Anchor("faster", "moves", "twist", "speed", after="full_limit", until="finish", k=20),
    Anchor("at_speed", "first", "twist", f"speed >= {ORIGINAL_LIMIT - 0.89}", after="faster"),
), (
    Metric("FWZ-1", "route", {"view": "route", "column": "lanelets", "which": "first", "members": "original_lanes", "relation": "contains"}),
    Metric("FWZ-8", "route", {"view": "route", "column": "lanelets", "which": "last", "members": "closed_lanes", "relation": "avoids"}),
    Metric("FWZ-2", "steady_before", {"view": "twist", "holds": STEADY, "event": "first_control", "seconds": 5.0, "begin": "start"}),
    Metric("FWZ-7", "always", {"view": "route_state", "holds": f"abs(speed_limit - {ADVISORY_LIMIT}) < 0.03", "window": ("enter", "exit", 2.0, 2.0)}),
    Metric("FWZ-9", "exists", {"view": "control", "holds": "choice = 5"}),
    Metric("FWZ-10", "acked", {"view": "control", "key": "part", "acks": "ack", "seconds": 1.0}),
    Metric("FWZ-10-parts", "complete", {"view": "ack", "part": "part", "n": 3}),
    Metric("FWZ-12", "paired_wait", {"calls": "control", "responses": "route", "seconds": 3.0}),
    Metric("FWZ-15", "interval_length", {"view": "trajectory", "holds": "planner = ''", "seconds": 5.0, "window": ("start", "finish")}),
    Metric("FWZ-23", "begins_within", {"view": "twist", "value": "speed", "sign": -1, "k": 10, "window": ("slow_limit", "finish"), "below": 1.3}),
    Metric("FWZ-24", "value_at", {"view": "twist", "value": "speed", "at": "enter", "low": ADVISORY_LIMIT - MPH_2, "high": ADVISORY_LIMIT + MPH_2}),
    Metric("FWZ-25", "section", {"view": "twist", "value": "speed", "begins": "speed IS NOT NULL", "ends": f"speed <= {ADVISORY_LIMIT + 1.1176}", "low": -2.0, "window": ("slower", None)}),
    Metric("FWZ-26", "begins_within", {"view": "twist", "value": "speed", "sign": 1, "k": 20, "window": ("full_limit", "finish"), "seconds": 10.0}),
    Metric("FWZ-27", "section", {"view": "twist", "value": "speed", "begins": "speed IS NOT NULL", "ends": f"speed >= {ORIGINAL_LIMIT - 0.89}", "low": 0.0, "window": ("faster", None)}),
    Metric("FWZ-27-second", "second_rate", {"view": "twist", "value": "speed", "limit": 1.5, "window": ("faster", "at_speed"), "signed": True}),
    Metric("FWZ-29", "held", {"view": "twist", "holds": STEADY, "seconds": 5.0, "window": ("exit", "finish")}),
    Metric("FWZ-32", "paired_wait", {"calls": "request_out", "responses": "control", "seconds": 1.0}),
))

FREIGHT_EMERGENCY = UseCase("freight_emergency", ENGAGEMENT + (
    Anchor("siren_on", "first", "bsm", "siren AND light"),
    Anchor("detected", "first", "erv", "detected", after="siren_on"),
    Anchor("attempt", "first", "erv", "action = 'Attempting'", after="start"),
    Anchor("planned", "first", "maneuver", "type = 1", after="attempt"),
    Anchor("other_lane", "switch", "route_state", LANE, after="start"),
    Anchor("lane_taken", "switch", "route_state", "lanelet_id", after="other_lane"),
    Anchor("slowed", "first", "twist", f"speed <= {HAZARD_SPEED}", after="lane_taken", until="finish"),
    Anchor("faster", "moves", "twist", "speed", after="slowed", until="finish", k=20, at="kth"),
    Anchor("at_speed", "first", "twist", f"speed >= {FREIGHT_LIMIT - 1.1176}", after="faster", until="finish"),
    Anchor("hazard", "first", "erv", "action = 'possible.'", after="start", until="finish"),
    Anchor("warned", "first", "warning", "t >= 0", after="start", until="finish"),
    Anchor("hazard_ack", "first", "ack", "part >= 0", after="start", until="finish"),
), (
    Metric("FER-1", "window_frequency", {"view": "bsm", "seconds": 5.0, "hz": 8 - 0.05}),
    Metric("FER-2", "steady_before", {"view": "twist", "holds": FREIGHT_STEADY, "event": "detected", "seconds": 5.0, "begin": "start"}),
    Metric("FER-3", "time_share", {"view": "twist", "holds": FREIGHT_STEADY, "share": 90.0, "window": ("start", "detected")}),
    Metric("FER-4", "exists", {"view": "bsm", "holds": "NOT part2"}),
    Metric("FER-5", "window_frequency", {"view": "bsm", "seconds": 5.0, "hz": 8 - 0.05, "window": ("start", None)}),
    Metric("FER-8", "exists", {"view": "bsm", "holds": "part2 AND siren AND light"}),
    Metric("FER-9", "mean_frequency", {"view": "bsm", "hz": 8.0, "where": "siren AND light", "window": ("start", None)}),
    Metric("FER-10", "anchor_gap", {"first": "siren_on", "second": "detected", "high": 1.0}),
    Metric("FER-11", "exists_as", {"view": "erv", "holds": "detected", "unless": "opposing"}),
    Metric("FER-12", "never", {"view": "erv", "holds": "detected AND action = 'Opposing'"}),
    Metric("FER-14", "exists", {"view": "erv", "holds": "action = 'Attempting'", "window": ("start", None)}),
    Metric("FER-15", "anchor_gap", {"first": "attempt", "second": "planned", "high": 1.05}),
    Metric("FER-16", "wait", {"since": "planned", "view": "trajectory", "holds": "planner = ''", "seconds": 0.25}),
    Metric("FER-22", "both", {"view": "route_state", "one": f"{LANE} = 'right'", "two": f"{LANE} = 'middle'", "window": ("start", None)}),
    Metric("FER-23", "lane_speed", {"view": "route_state", "across": "cross_track", "lane": LANE, "left": "other_lane", "taken": "lane_taken", "begin": "start", "low": 0.5, "high": 1.25}),
    Metric("FER-26", "row_run", {"view": "twist", "holds": f"speed < {HAZARD_SPEED}", "k": 10, "window": ("lane_taken", "finish")}),
    Metric("FER-27", "section", {"view": "twist", "value": "speed", "begins": "speed IS NOT NULL", "ends": f"speed <= {HAZARD_SPEED}", "low": -1.05, "window": ("lane_taken", "finish")}),
    Metric("FER-27-second", "second_rate", {"view": "twist", "value": "speed", "limit": 2.05, "window": ("lane_taken", "finish")}),
    Metric("FER-28", "exists", {"view": "erv", "holds": "passing > 10.0", "window": ("slowed", "finish")}),
    Metric("FER-29", "both", {"view": "maneuver", "one": "type = 1 AND array_contains(middle_lanes, start_lane) AND array_contains(right_lanes, end_lane)",
                              "two": "type = 1 AND array_contains(right_lanes, start_lane) AND array_contains(middle_lanes, end_lane)", "window": ("attempt", None)}),
    Metric("FER-30", "section", {"view": "twist", "value": "speed", "begins": "speed IS NOT NULL", "ends": f"speed >= {FREIGHT_LIMIT - 1.1176}", "high": 1.05, "window": ("faster", "finish")}),
    Metric("FER-30-second", "second_rate", {"view": "twist", "value": "speed", "limit": 2.05, "window": ("faster", "at_speed")}),
    Metric("FER-32", "anchor_gap", {"first": "hazard", "second": "warned", "low": -0.1, "high": 0.1}),
    Metric("FER-33", "row_run", {"view": "twist", "holds": f"speed < {HAZARD_SPEED}", "k": 10, "window": ("hazard", "finish")}),
    Metric("FER-34", "anchor_gap", {"first": "warned", "second": "hazard_ack", "high": 1.0}),
    Metric("FER-35", "count_limit", {"view": "warning", "holds": "t >= 0", "most": 10, "window": ("start", "finish")}),
    Metric("FER-35-after", "none_after", {"view": "warning", "holds": "t >= 0", "since": "hazard_ack", "seconds": 0.1, "to": "finish"}),
))

TRAFFIC_INCIDENT = UseCase("traffic_incident", ENGAGEMENT + FENCE + CONTROL + (_faster(),), (
    Metric("TIM-1", "route", {"view": "route", "column": "lanelets", "which": "first", "members": "original_lanes", "relation": "contains"}),
    Metric("TIM-11", "route", {"view": "route", "column": "lanelets", "which": "last", "members": "closed_lanes", "relation": "avoids"}),
    Metric("TIM-2", "steady_before", {"view": "twist", "holds": STEADY, "event": "first_control", "seconds": 10.0, "begin": "start"}),
    Metric("TIM-10", "always", {"view": "route_state", "holds": f"abs(speed_limit - {ADVISORY_LIMIT}) < 0.01", "window": ("enter", "exit", 0, 0.8)}),
    Metric("TIM-28", "exists", {"view": "control", "holds": f"choice = 12 AND abs(maxspeed - {ADVISORY_LIMIT}) < 0.01"}),
    Metric("TIM-13", "merge_end", {"view": "plan_points", "plan": "plan", "target": "target", "planner": "planner", "merging": MERGING, "x": "x", "y": "y",
                                   "window": ("start", "enter"), "place_view": "pose", "low": 0.0, "high": 50.0}),
    Metric("TIM-20", "merge_start", {"view": "plan_points", "planner": "planner", "merging": MERGING, "x": "x", "y": "y", "since": "exit", "place_view": "pose", "low": 0.0, "high": 30.0}),
    *_driving("TIM-22", "TIM-21", "TIM-23", "TIM-24", "TIM-25", "TIM-15"),
))

PLATOONING = UseCase("platooning", ENGAGEMENT + PLATOON, (
    Metric("formation", "anchor_gap", {"first": "asked", "second": "joined", "low": 0.0, "high": 2.0}),
    Metric("control-parts", "complete", {"view": "control", "part": "part", "n": 3, "window": ("asked", None)}),
    Metric("cross-track", "always", {"view": "route_state", "holds": "abs(cross_track) < 1.5", "window": ("joined", "finish")}),
    Metric("distance", "value_at", {"view": "platoon", "value": "actual_gap", "at": "joined", "high": 90.0}),
    Metric("time-gap", "value_at", {"view": "platoon", "value": TIME_GAP, "at": "joined", "high": 15.0}),
    Metric("limit-changes", "hysteresis_count", {"view": "route_state", "value": "speed_limit", "band": 0.1, "low": 1, "high": None}),
))

PORT_DRAYAGE = UseCase("port_drayage", ENGAGEMENT + (
    Anchor("completed", "first", "route_event", "event = 3", after="start"),
    Anchor("arrival", "first", "op_out", "operation = 'PICKUP'", after="start"),
    Anchor("next_goal", "first", "op_in", "operation = 'DROPOFF'", after="arrival"),
    Anchor("route_set", "first", "route_event", "event = 2", after="next_goal"),
    Anchor("stopped", "first", "twist", "speed < 0.3", after="start"),
), (
    Metric("PD-1", "exists", {"view": "twist", "holds": STEADY, "window": ("start", "finish")}),
    Metric("PD-4", "listed", {"view": "route_state", "column": "lanelet_id", "where": "speed_limit BETWEEN 8.94 AND 11.18", "members": "port_order", "window": ("start", "finish")}),
    Metric("PD-19", "always", {"view": "route_state", "holds": f"abs(speed_limit - {ADVISORY_LIMIT}) < 0.5", "where": "lanelet_id < port_lane", "window": ("start", "finish")}),
    Metric("PD-23", "section", {"view": "twist", "value": "speed", "begins": "speed > 0.1", "ends": NEAR_LIMIT, "low": 1.0, "window": ("start", "finish")}),
    Metric("PD-23-second", "second_rate", {"view": "twist", "value": "speed", "limit": 2.0, "window": ("start", "finish")}),
    Metric("PD-24", "section", {"view": "twist", "value": "speed", "begins": NEAR_LIMIT, "ends": "speed < 0.3", "high": -1.0, "window": ("start", "completed")}),
    Metric("PD-24-second", "second_rate", {"view": "twist", "value": "speed", "limit": 2.0, "window": ("start", "completed")}),
    Metric("PD-25", "wait", {"since": "completed", "view": "op_out", "holds": "operation IS NOT NULL", "seconds": 3.0}),
    Metric("PD-18", "exists", {"view": "op_out", "holds": "operation = 'PICKUP'", "window": ("start", None)}),
    Metric("PD-9", "exists", {"view": "op_in", "holds": "operation = 'DROPOFF'", "window": ("arrival", None)}),
    Metric("PD-20", "exists", {"view": "op_in", "holds": "operation = 'DROPOFF'", "window": ("arrival", None)}),
    Metric("PD-10", "wait", {"since": "next_goal", "view": "ui", "holds": "popup", "seconds": 5.0}),
    Metric("PD-21", "anchor_gap", {"first": "arrival", "second": "next_goal", "below": 1.5}),
    Metric("PD-22", "anchor_gap", {"first": "next_goal", "second": "route_set", "below": 3.0}),
    Metric("PD-2", "value_at", {"view": "pose", "value": "sqrt((x - stop_x) * (x - stop_x) + (y - stop_y) * (y - stop_y)) - stop_offset", "at": "stopped", "high": 3.0}),
    Metric("PD-11", "value_at", {"view": "pose", "value": "sqrt((x - stop_x) * (x - stop_x) + (y - stop_y) * (y - stop_y)) - stop_offset", "at": "stopped", "high": 10.0}),
))

INTERSECTION = UseCase("intersection", ENGAGEMENT, (
    Metric("M1.2-signal", "window_band", {"view": "spat", "seconds": 1.0, "low": 9.0, "high": 11.0, "window": ("start", "finish")}),
    Metric("M1.2-map", "window_band", {"view": "map", "seconds": 5.0, "low": 0.5, "high": 1.5, "window": ("start", "finish")}),
    Metric("M2.1", "order", {"view": "route_state", "column": "lanelet_id", "values": "lane_order", "window": ("start", "finish")}),
    Metric("M2.3", "never", {"view": "entry", "holds": "lanelet_id = right_lane AND phase <> 6", "window": ("start", "finish")}),
    Metric("M2.5", "second_rate", {"view": "twist", "value": "speed", "limit": 3.0, "window": ("start", "finish")}),
))

SCALE_VEHICLE = UseCase("scale_vehicle", (), (
    Metric("SV-01", "paired_wait", {"calls": "call", "responses": "plan", "seconds": 3.0}),
    Metric("SV-02", "exists", {"view": "plan", "holds": "t >= 0"}),
    Metric("SV-03", "always", {"view": "route_state", "holds": "abs(cross_track) < 0.3"}),
    Metric("SV-03-share", "time_share", {"view": "route_state", "holds": "abs(cross_track) < 0.2", "share": 95.0}),
    Metric("SV-05", "plateau_error", {"view": "speed_target", "value": "speed", "target": "target", "tolerance": 0.2, "skip": 1}),
    Metric("SV-06", "turn_speed", {"view": "speed_target", "value": "speed", "target": "target", "share": 0.5}),
    Metric("SV-07", "arrival_distance", {"view": "ops", "call": "side = 'goal'", "answer": "side = 'ack'", "x": "x", "y": "y", "most": 0.5}),
    Metric("SV-08", "exists", {"view": "op_out", "holds": "t >= 0"}),
    Metric("SV-09", "exists", {"view": "op_in", "holds": "t >= 0"}),
    Metric("SV-10", "paired_wait", {"calls": "op_in", "responses": "plan", "seconds": 3.0}),
    Metric("SV-13", "acked", {"view": "op_in", "key": "operation", "acks": "op_out", "seconds": 60.0, "where": "operation IN ('PICKUP', 'DROPOFF')"}),
    Metric("SV-14", "exists", {"view": "op_out", "holds": "operation = 'PORT_CHECKPOINT'"}),
    Metric("SV-17", "acked", {"view": "op_in", "key": "operation", "acks": "op_out", "seconds": 60.0, "where": "operation = 'HOLDING_AREA'"}),
))

USE_CASES = {u.name: u for u in (BASIC_TRAVEL, WORK_ZONE, FREIGHT_WORK_ZONE, FREIGHT_EMERGENCY, TRAFFIC_INCIDENT, PLATOONING, PORT_DRAYAGE,
                                 INTERSECTION, SCALE_VEHICLE)}
