"""The metric rules once more as DuckDB SQL, the check on the Spark rules. Written from the rules'
definitions; each function returns SELECT run_id, value, passed. Which rule judges a metric, with which limits, is said a second
time in `expected`, by hand."""

from __future__ import annotations

S = 1_000_000_000
W = "(PARTITION BY run_id ORDER BY t, seq)"
FEET = 3.28084


def rows(view, where=None, window=None):
    sql = f"SELECT v.* FROM {view} v"
    conditions = [f"({where})"] if where else []
    if window:
        margin = [int(m * S) for m in (window[2:] if len(window) > 2 else (0, 0))]
        sql += " JOIN anchors USING (run_id)"
        if window[0]:
            conditions.append(f"v.t >= anchors.\"{window[0]}\" + {margin[0]}")
        if window[1]:
            conditions.append(f"v.t <= anchors.\"{window[1]}\" - {margin[1]}")
    if conditions:
        sql = f"SELECT * FROM (SELECT * FROM {view} WHERE {where}) v" if where and not window else sql
        if window:
            inner = f"(SELECT * FROM {view}{' WHERE ' + where if where else ''})"
            sql = f"SELECT v.* FROM {inner} v JOIN anchors USING (run_id) WHERE " + " AND ".join(conditions[1 if where else 0:])
    return f"({sql})"


def band(value, low=None, high=None):
    tests = [f"({value}) >= {low}"] * (low is not None) + [f"({value}) <= {high}"] * (high is not None) or ["true"]
    return f"CASE WHEN ({value}) IS NOT NULL THEN {' AND '.join(tests)} END"


def judged(source, value, low=None, high=None):
    return f"SELECT run_id, value, {band('value', low, high)} AS passed FROM (SELECT run_id, {value} AS value FROM {source})"


def _gaps(view, where, window, extra=""):
    return f"(SELECT run_id{extra}, t - lag(t) OVER {W} AS gap FROM {rows(view, where, window)})"


def gap_share(view, limit, share, where=None, window=None):
    inner = f"(SELECT run_id, coalesce(sum(gap) FILTER (gap < {int(limit * S)}), 0) * 100.0 / nullif(sum(gap), 0) AS x FROM {_gaps(view, where, window)} GROUP BY run_id)"
    return judged(inner, "x", low=share)


def gap_max(view, limit, where=None, window=None):
    return f"SELECT run_id, max(gap) / {S} AS value, max(gap) / {S} < {limit} AS passed FROM {_gaps(view, where, window)} GROUP BY run_id"


def time_share(view, holds, share, window=None):
    inner = f"(SELECT run_id, coalesce(sum(gap) FILTER (ok), 0) * 100.0 / nullif(sum(gap), 0) AS x FROM {_gaps(view, None, window, f', ({holds}) AS ok')} GROUP BY run_id)"
    return judged(inner, "x", low=share)


def always(view, holds, where=None, window=None):
    return f"SELECT run_id, count(*) FILTER ({holds}) * 100.0 / count(*) AS value, count(*) FILTER ({holds}) = count(*) AS passed FROM {rows(view, where, window)} GROUP BY run_id"


def both(view, one, two, where=None, window=None):
    return f"""SELECT run_id, least(count(*) FILTER ({one}), count(*) FILTER ({two})) AS value, count(*) FILTER ({one}) > 0 AND count(*) FILTER ({two}) > 0 AS passed
 FROM {rows(view, where, window)} GROUP BY run_id"""


def none_after(view, holds, since, seconds, to=None):
    until = f' AND v.t <= anchors."{to}"' if to else ""
    return f"""SELECT anchors.run_id, count(v.run_id) AS value, count(v.run_id) = 0 AS passed FROM anchors
 LEFT JOIN (SELECT * FROM {view} WHERE {holds}) v ON v.run_id = anchors.run_id AND v.t > anchors."{since}" + {int(seconds * S)}{until}
 WHERE anchors."{since}" IS NOT NULL GROUP BY anchors.run_id"""


def never(view, holds, where=None, window=None):
    return f"SELECT run_id, count(*) FILTER ({holds}) AS value, count(*) FILTER ({holds}) = 0 AS passed FROM {rows(view, where, window)} GROUP BY run_id"


def exists(view, holds, where=None, window=None):
    return f"SELECT run_id, count(*) FILTER ({holds}) AS value, count(*) FILTER ({holds}) > 0 AS passed FROM {rows(view, where, window)} GROUP BY run_id"


def count_limit(view, holds, most, where=None, window=None):
    return f"SELECT run_id, count(*) FILTER ({holds}) AS value, count(*) FILTER ({holds}) <= {most} AS passed FROM {rows(view, where, window)} GROUP BY run_id"


def section(view, value, begins, ends, low=None, high=None, window=None):
    return f"""WITH r AS (SELECT run_id, t, seq, {value} AS v, ({begins}) AS b, ({ends}) AS e FROM {rows(view, None, window)}),
 a AS (SELECT run_id, min(t) FILTER (b) AS t0, first(v ORDER BY t, seq) FILTER (b) AS v0 FROM r GROUP BY run_id),
 z AS (SELECT r.run_id, min(t) FILTER (e AND t > t0) AS t1, first(v ORDER BY t, seq) FILTER (e AND t > t0) AS v1 FROM r JOIN a USING (run_id) GROUP BY r.run_id)
 {judged('a JOIN z USING (run_id)', f'(v1 - v0) / ((t1 - t0) / {S}.0)', low, high)}"""


def second_rate(view, value, limit, window=None, signed=False):
    rate = "(f.v - r.v) / ((f.t - r.t) / 1000000000.0)"
    return f"""WITH r AS (SELECT run_id, t, seq, {value} AS v, t + {S} AS at FROM {rows(view, None, window)}),
 f AS (SELECT run_id, t, arg_min(v, seq) AS v FROM r GROUP BY run_id, t),
 j AS (SELECT r.run_id, max({rate if signed else f'abs({rate})'}) AS x FROM r ASOF LEFT JOIN f ON r.run_id = f.run_id AND r.at <= f.t GROUP BY r.run_id)
 {judged('j', 'x', high=limit)}"""


def _islands(view, holds, window):
    return f"""a AS (SELECT *, ({holds}) AS on_, lag({holds}) OVER {W} AS was, lag(t) OVER {W} AS pt, lead(t) OVER {W} AS nt FROM {rows(view, None, window)}),
 b AS (SELECT *, sum(CASE WHEN on_ AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM a)"""


def held(view, holds, seconds, window=None):
    return f"""WITH {_islands(view, holds, window)}, c AS (SELECT run_id, isl, max(t) - min(t) AS d FROM b WHERE on_ GROUP BY run_id, isl),
 d AS (SELECT a.run_id, max(d) / {S} AS value FROM (SELECT DISTINCT run_id FROM a) a LEFT JOIN c USING (run_id) GROUP BY a.run_id)
 SELECT run_id, value, coalesce(value >= {seconds}, false) AS passed FROM d"""


def row_run(view, holds, k, window=None):
    return f"""WITH a AS (SELECT run_id, t, seq, coalesce({holds}, false) AS h, row_number() OVER {W} AS n FROM {rows(view, None, window)}),
 b AS (SELECT run_id, n - row_number() OVER {W} AS g FROM a WHERE h), c AS (SELECT run_id, g, count(*) AS x FROM b GROUP BY run_id, g)
 SELECT a.run_id, coalesce(max(x), 0) AS value, coalesce(max(x), 0) >= {k} AS passed FROM (SELECT DISTINCT run_id FROM a) a LEFT JOIN c USING (run_id) GROUP BY a.run_id"""


def steady_to(view, holds, to, last, seconds):
    return f"""WITH r AS (SELECT v.run_id, any_value(anchors."{to}") AS e, min(v.t) FILTER ({holds}) AS t0 FROM {view} v JOIN anchors USING (run_id)
 WHERE v.t >= anchors."{to}" - {int(last * S)} AND v.t <= anchors."{to}" GROUP BY v.run_id)
 SELECT run_id, (e - t0) / {S} AS value, coalesce((e - t0) / {S} >= {seconds}, false) AS passed FROM r"""


def interval_length(view, holds, seconds, window=None):
    return f"""WITH {_islands(view, holds, window)}, c AS (SELECT run_id, isl, min(t) AS t0, max(coalesce(nt, t)) AS t1 FROM b WHERE on_ GROUP BY run_id, isl),
 d AS (SELECT run_id, max(t1 - t0) / {S} AS x FROM c GROUP BY run_id) {judged('d', 'x', high=seconds)}"""


def _settled(view, holds, window, where=None):
    return f"""r AS (SELECT run_id, t, seq, coalesce({holds}, false) AS ok, row_number() OVER {W} AS n FROM {rows(view, where, window)}),
 l AS (SELECT run_id, coalesce(max(n) FILTER (NOT ok), 0) AS last_out FROM r GROUP BY run_id),
 st AS (SELECT l.run_id, min(t) FILTER (n = last_out + 1) AS settled FROM l JOIN r USING (run_id) GROUP BY l.run_id)"""


def steady_before(view, holds, event, seconds, begin=None):
    x = f'(anchors."{event}" - settled) / {S}'
    return f"WITH {_settled(view, holds, (begin, event))} SELECT run_id, {x} AS value, coalesce({x} >= {seconds}, false) AS passed FROM st JOIN anchors USING (run_id)"


def settle(view, holds, seconds, window, where=None):
    x = f'(settled - anchors."{window[0]}") / {S}'
    return f"WITH {_settled(view, holds, window, where)} SELECT run_id, {x} AS value, coalesce({x} <= {seconds}, false) AS passed FROM st JOIN anchors USING (run_id)"


def _moves(source, value, sign, k):
    """base, start and kth of the first stretch of k rises or falls, per run."""
    op = ">" if sign > 0 else "<"
    return f"""a AS (SELECT run_id, t, seq, coalesce(({value}) {op} lag({value}) OVER {W}, false) AS mv, row_number() OVER {W} AS n FROM {source}),
 b AS (SELECT run_id, n, n - row_number() OVER {W} AS g FROM a WHERE mv), c AS (SELECT run_id, min(n) AS n0 FROM b GROUP BY run_id, g HAVING count(*) >= {k}),
 d AS (SELECT run_id, min(n0) AS n0 FROM c GROUP BY run_id),
 e AS (SELECT run_id, min(t) FILTER (n = n0 - 1) AS base, min(t) FILTER (n = n0) AS start, min(t) FILTER (n = n0 + {k} - 1) AS kth FROM d JOIN a USING (run_id) GROUP BY run_id)"""


def begins_within(view, value, sign, k, window, seconds=None, below=None):
    x = f'(base - anchors."{window[0]}") / {S}'
    test = f"{x} <= {seconds}" if below is None else f"{x} < {below}"
    return f"""WITH {_moves(rows(view, None, window), value, sign, k)}, s AS (SELECT DISTINCT run_id FROM a)
 SELECT s.run_id, {x} AS value, coalesce({test}, false) AS passed FROM s JOIN anchors USING (run_id) LEFT JOIN e USING (run_id)"""


def _due(source, seen, value, test):
    return f"SELECT run_id, {value} AS value, CASE WHEN {seen} THEN coalesce({test}, false) END AS passed FROM {source}"


def _test(value, low=None, high=None, below=None):
    return " AND ".join([f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None) + [f"{value} < {below}"] * (below is not None)) or f"{value} IS NOT NULL"


def wait(since, view, holds, seconds=None, low=0.0, below=None):
    x = f'(hit - anchors."{since}") / {S}'
    return f"""WITH h AS (SELECT run_id, min(t) AS hit FROM {rows(view, holds, (since, None))} GROUP BY run_id)
 {_due('anchors LEFT JOIN h USING (run_id)', f'anchors."{since}" IS NOT NULL', x, _test(x, low, seconds, below))}"""


def anchor_gap(first, second, low=None, high=None, below=None):
    x = f'("{second}" - "{first}") / {S}'
    return _due("anchors", f'"{first}" IS NOT NULL', x, _test(x, low, high, below))


def _at(name, view, value, at, where=None):
    """The value of the first row at or after an anchor, as a CTE with run_id and x."""
    return f"""{name} AS (SELECT v.run_id, first({value} ORDER BY v.t, v.seq) AS x FROM (SELECT * FROM {view}{' WHERE ' + where if where else ''}) v JOIN anchors USING (run_id)
 WHERE v.t >= anchors."{at}" GROUP BY v.run_id)"""


def value_gap(view, value, at, other_view, other_value, other_at, low=None, high=None, scale=1.0):
    x = f"(one.x - two.x) * {scale}"
    return f"""WITH {_at('one', view, value, at)}, {_at('two', other_view, other_value, other_at)}
 {_due('anchors LEFT JOIN one USING (run_id) LEFT JOIN two USING (run_id)', f'anchors."{other_at}" IS NOT NULL', x, _test(x, low, high))}"""


def moved_feet(at, since, place_view, place, low=None, high=None):
    return value_gap(place_view, place, at, place_view, place, since, low, high, FEET)


def needed_deceleration(view, value, target, at, place_view, place, to, limit):
    x = f"(s.x * s.x - {target} * {target}) / nullif(2 * (b.x - a.x), 0)"
    return f"""WITH {_at('s', view, value, at)}, {_at('a', place_view, place, at)}, {_at('b', place_view, place, to)}, z AS (SELECT run_id, {x} AS x FROM s JOIN a USING (run_id) JOIN b USING (run_id))
 SELECT run_id, x AS value, abs(x) <= {limit} AS passed FROM z"""


def stop_short(view, x, y, goal_x, goal_y, front, at, start, limit):
    far = lambda p, q, r, s: f"sqrt(({p} - {r}) ** 2 + ({q} - {s}) ** 2)"
    return f"""WITH {_at('px', view, x, at)}, {_at('py', view, y, at)}, {_at('sx', view, x, start)}, {_at('sy', view, y, start)},
 d AS (SELECT run_id, {far('px.x', 'py.x', f'runs.{goal_x}', f'runs.{goal_y}')} AS gap, {far('px.x', 'py.x', 'sx.x', 'sy.x')} < {far(f'runs.{goal_x}', f'runs.{goal_y}', 'sx.x', 'sy.x')} AS before, runs.{front} AS f
 FROM px JOIN py USING (run_id) JOIN sx USING (run_id) JOIN sy USING (run_id) JOIN runs USING (run_id))
 SELECT run_id, CASE WHEN before THEN gap - f ELSE gap + f END AS value, before AND gap - f >= 0 AND gap - f < {limit} AS passed FROM d"""


def lane_speed(view, across, lane, left, taken, begin, low, high):
    x = "abs((z.v - a.v) / nullif((z.t - a.t) / 1000000000.0, 0))"
    return f"""WITH a AS (SELECT v.run_id, last(v.t ORDER BY v.t, v.seq) AS t, last({across} ORDER BY v.t, v.seq) AS v FROM (SELECT * FROM {view} WHERE ({lane}) IS NOT NULL) v JOIN anchors USING (run_id)
 WHERE v.t >= anchors."{begin}" AND v.t < anchors."{left}" GROUP BY v.run_id),
 z AS (SELECT v.run_id, first(v.t ORDER BY v.t, v.seq) AS t, first({across} ORDER BY v.t, v.seq) AS v FROM {view} v JOIN anchors USING (run_id) WHERE v.t >= anchors."{taken}" GROUP BY v.run_id)
 SELECT run_id, {x} AS value, {x} BETWEEN {low} AND {high} AS passed FROM a JOIN z USING (run_id)"""


def follows(view, column, one, two, where=None, window=None):
    return f"""WITH r AS (SELECT run_id, {column} AS v, lag({column}) OVER {W} AS p FROM {rows(view, where, window)})
 SELECT run_id, count(*) FILTER (p = {one} AND v = {two}) AS value, count(*) FILTER (p = {one} AND v = {two}) > 0 AS passed FROM r GROUP BY run_id"""


def listed(view, column, where, members, window=None):
    return f"""WITH r AS (SELECT run_id, t, seq, {column} AS v, lag({column}) OVER {W} AS p, row_number() OVER {W} AS n, coalesce({where}, false) AS inside FROM {rows(view, None, window)}),
 l AS (SELECT run_id, coalesce(list(v ORDER BY t, seq) FILTER (inside AND (n = 1 OR p IS DISTINCT FROM v)), []) AS l FROM r GROUP BY run_id)
 SELECT run_id, len(l) AS value, l = {members} AS passed FROM l JOIN runs USING (run_id)"""


def merge_start(view, planner, merging, x, y, since, place_view, low=None, high=None):
    test = f"{planner} IN ({', '.join(repr(m) for m in merging)})"
    far = "sqrt((mx.x - px.x) ** 2 + (my.x - py.x) ** 2) * 3.28"
    return f"""WITH {_at('px', place_view, x, since)}, {_at('py', place_view, y, since)}, {_at('mx', view, x, since, test)}, {_at('my', view, y, since, test)}
 SELECT px.run_id, {far} AS value, coalesce({_test(far, low, high)}, false) AS passed FROM px JOIN py USING (run_id) LEFT JOIN mx USING (run_id) LEFT JOIN my USING (run_id)"""


def merge_end(view, plan, target, planner, merging, x, y, window, place_view, low, high):
    w = "(PARTITION BY run_id, plan ORDER BY target, seq)"
    names = ", ".join(repr(m) for m in merging)
    return f"""WITH r AS (SELECT run_id, {plan} AS plan, {target} AS target, seq, {x} AS x, {y} AS y, coalesce({planner} IN ({names}), false) AS m FROM {rows(view, None, window)}),
 n AS (SELECT *, lead(m) OVER {w} AS nm, lead(target) OVER {w} AS nt, lag(target) OVER {w} AS pt FROM r),
 e AS (SELECT run_id, plan, first(x ORDER BY target, seq) AS x, first(y ORDER BY target, seq) AS y FROM n
  WHERE m AND ((NOT nm AND nt - target > 1000000) OR (nt IS NULL AND target - pt > 1000000)) GROUP BY run_id, plan),
 {_at('px', place_view, x, window[1])}, {_at('py', place_view, y, window[1])},
 d AS (SELECT run_id, sqrt((e.x - px.x) ** 2 + (e.y - py.x) ** 2) * 3.28 AS feet FROM e JOIN px USING (run_id) JOIN py USING (run_id))
 SELECT s.run_id, max(feet) AS value, coalesce(min(feet) >= {low} AND max(feet) <= {high}, false) AS passed FROM (SELECT DISTINCT run_id FROM r) s LEFT JOIN d USING (run_id) GROUP BY s.run_id"""


def exists_as(view, holds, unless, where=None, window=None):
    return f"""SELECT run_id, count(*) FILTER ({holds}) AS value, CASE WHEN bool_or({unless}) THEN count(*) FILTER ({holds}) = 0 ELSE count(*) FILTER ({holds}) > 0 END AS passed
 FROM {rows(view, where, window)} GROUP BY run_id"""


def order(view, column, values, window=None):
    return f"""WITH r AS (SELECT run_id, t, seq, {column} AS v FROM {rows(view, None, window)}), a AS (SELECT *, lag(v) OVER {W} AS p FROM r),
 c AS (SELECT run_id, list(v) OVER (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS l FROM a WHERE p IS DISTINCT FROM v),
 d AS (SELECT c.run_id, l, runs.{values} AS w FROM c JOIN runs USING (run_id)),
 e AS (SELECT run_id, CAST(count(*) FILTER (len(l) >= len(w) AND l[len(l) - len(w) + 1:len(l)] = w) AS DOUBLE) AS x FROM d GROUP BY run_id) {judged('e', 'x', low=1)}"""


def route(view, column, which, members, relation, where=None):
    pick = "first" if which == "first" else "last"
    test = f"x = len(list_distinct({members}))" if relation == "contains" else "x = 0"
    return f"""WITH r AS (SELECT run_id, {pick}({column} ORDER BY t, seq) AS l FROM {rows(view, where)} GROUP BY run_id),
 h AS (SELECT run_id, {members}, len(list_intersect(l, {members})) AS x FROM r JOIN runs USING (run_id)) SELECT run_id, CAST(x AS DOUBLE) AS value, {test} AS passed FROM h"""


def complete(view, part, n, where=None, window=None):
    return f"WITH r AS (SELECT run_id, count(DISTINCT {part}) AS x FROM {rows(view, where, window)} GROUP BY run_id) {judged('r', 'x', low=n)}"


def acked(view, key, acks, seconds, where=None, window=None):
    return f"""WITH s AS (SELECT run_id, {key} AS k0, min(t) AS t0 FROM {rows(view, where, window)} GROUP BY ALL), g AS (SELECT run_id, {key} AS k0, min(t) AS t1 FROM {acks} GROUP BY ALL),
 p AS (SELECT run_id, abs(t1 - t0) / {S} AS w FROM s LEFT JOIN g USING (run_id, k0))
 SELECT run_id, CASE WHEN count(*) = count(w) THEN max(w) END AS value, count(*) = count(w) AND max(w) <= {seconds} AS passed FROM p GROUP BY run_id"""


def _windows(view, seconds, where, window):
    return f"""r AS (SELECT run_id, count(*) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN {int(seconds * S)} PRECEDING AND CURRENT ROW) / {float(seconds)} AS f,
 t - min(t) OVER (PARTITION BY run_id) >= {int(seconds * S)} AS warm FROM {rows(view, where, window)})"""


def window_frequency(view, seconds, hz, where=None, window=None):
    return f"WITH {_windows(view, seconds, where, window)}, m AS (SELECT run_id, min(f) AS x FROM r WHERE warm GROUP BY run_id) {judged('m', 'x', low=hz)}"


def window_band(view, seconds, low, high, where=None, window=None):
    ok = f"f BETWEEN {low} AND {high}"
    return f"WITH {_windows(view, seconds, where, window)} SELECT run_id, count(*) FILTER ({ok}) * 100.0 / count(*) AS value, bool_and({ok}) AS passed FROM r WHERE warm GROUP BY run_id"


def mean_frequency(view, hz, where=None, window=None):
    return f"WITH r AS (SELECT run_id, (count(*) - 1) / nullif((max(t) - min(t)) / {S}.0, 0) AS x FROM {rows(view, where, window)} GROUP BY run_id) {judged('r', 'x', low=hz)}"


def value_at(view, value, at, low=None, high=None, where=None):
    return f"WITH {_at('j', view, value, at, where)} {judged('j', 'x', low, high)}"


def paired_wait(calls, responses, seconds):
    w = "(PARTITION BY run_id ORDER BY t, side, seq)"
    return f"""WITH b AS (SELECT run_id, t, seq, 0 AS side FROM {calls} UNION ALL SELECT run_id, t, seq, 1 FROM {responses}),
 c AS (SELECT *, sum(1 - side) OVER {w} AS s, sum(side) OVER {w} AS g FROM b), d AS (SELECT *, greatest(0, max(g - s) OVER {w}) AS u FROM c),
 e AS (SELECT *, coalesce(lag(u) OVER {w}, 0) AS pu FROM d), x AS (SELECT run_id, s AS n, t AS t0 FROM e WHERE side = 0), y AS (SELECT run_id, g - u AS n, t AS t1 FROM e WHERE side = 1 AND u <= pu),
 z AS (SELECT run_id, max(coalesce((t1 - t0) / {S}, 'infinity'::DOUBLE)) AS v FROM x LEFT JOIN y USING (run_id, n) GROUP BY run_id) {judged('z', 'v', high=seconds)}"""


def plateau_error(view, value, target, tolerance, skip):
    return f"""WITH r AS (SELECT run_id, t, seq, {value} AS v, {target} AS g, max({target}) OVER (PARTITION BY run_id) AS top FROM {view}),
 a AS (SELECT *, lag(g = top) OVER {W} AS was FROM r), b AS (SELECT *, sum(CASE WHEN g = top AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM a),
 c AS (SELECT *, row_number() OVER (PARTITION BY run_id, isl ORDER BY t, seq) AS n FROM b WHERE g = top), d AS (SELECT run_id, max(abs(top - v)) AS x FROM c WHERE n > {skip} GROUP BY run_id)
 {judged('d', 'x', high=tolerance)}"""


def turn_speed(view, value, target, share):
    return f"""WITH r AS (SELECT run_id, t, seq, {value} AS v, {target} AS g, max({target}) OVER (PARTITION BY run_id) AS top FROM {view}),
 a AS (SELECT *, lag(g < top) OVER {W} AS was, lag(t) OVER {W} AS pt, lead(t) OVER {W} AS nt FROM r), b AS (SELECT *, sum(CASE WHEN g < top AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM a),
 c AS (SELECT run_id, isl, min(v / top) AS lo, bool_or(g = 0 OR pt IS NULL OR nt IS NULL) AS edge FROM b WHERE g < top GROUP BY run_id, isl), d AS (SELECT run_id, min(lo) AS x FROM c WHERE NOT edge GROUP BY run_id)
 {judged('d', 'x', low=share)}"""


def arrival_distance(view, call, answer, x, y, most):
    return f"""WITH r AS (SELECT *, CASE WHEN {call} THEN 0 WHEN {answer} THEN 1 END AS sd FROM {view}), a AS (SELECT *, lag(sd) OVER {W} AS was FROM r WHERE sd IS NOT NULL),
 h AS (SELECT * FROM a WHERE was IS DISTINCT FROM sd), n AS (SELECT *, lead(t) OVER {W} AS nt, lead({x}) OVER {W} AS nx, lead({y}) OVER {W} AS ny FROM h),
 d AS (SELECT run_id, max(sqrt(({x} - nx) ** 2 + ({y} - ny) ** 2)) AS v FROM n WHERE sd = 0 AND nt IS NOT NULL GROUP BY run_id) {judged('d', 'v', high=most)}"""


def hysteresis_count(view, value, band, low, high):
    # the level takes two values farther apart than the band, so every change of value is accepted
    return f"""WITH a AS (SELECT run_id, {value} AS v, lag({value}) OVER {W} AS p FROM {view}), c AS (SELECT run_id, count(*) FILTER (p IS DISTINCT FROM v) AS x FROM a GROUP BY run_id)
 {judged('c', 'CAST(x AS DOUBLE)', low, high)}"""


def anchors_sql(anchors):
    """`anchors` are dicts: name, kind, view, where and what the kind needs besides."""
    parts = ["a0 AS (SELECT DISTINCT run_id FROM msg)"]
    for i, a in enumerate(anchors, 1):
        known = f"a{i - 1}"
        later = ">=" if a["kind"] in ("switch", "moves") else ">"
        tests = [f'v.t {sign} {known}."{a[bound]}"' for bound, sign in (("after", later), ("until", "<=")) if bound in a]
        source = f"(SELECT v.* FROM {a['view']} v JOIN {known} USING (run_id) WHERE {' AND '.join(tests)})" if tests else a["view"]
        where = a["where"]
        if a["kind"] == "leave":
            found = f"""(WITH x AS (SELECT *, ({where}) AS on_ FROM {source}), y AS (SELECT run_id, min(t) FILTER (on_) AS t0 FROM x GROUP BY run_id),
 z AS (SELECT x.run_id, min(t) FILTER (NOT on_ AND t > t0) AS t1 FROM x JOIN y USING (run_id) GROUP BY x.run_id)
 SELECT x.run_id, coalesce(any_value(t1), max(t) FILTER (on_)) AS at FROM x JOIN z USING (run_id) GROUP BY x.run_id)"""
        elif a["kind"] == "switch":
            found = f"""(WITH x AS (SELECT run_id, t, seq, ({where}) AS lv FROM {source}), y AS (SELECT run_id, first(lv ORDER BY t, seq) AS l0 FROM x WHERE lv IS NOT NULL GROUP BY run_id)
 SELECT x.run_id, min(t) AS at FROM x JOIN y USING (run_id) WHERE lv <> l0 GROUP BY x.run_id)"""
        elif a["kind"] == "moves":
            found = f"(WITH {_moves(source, where, a['sign'], a['k'])} SELECT run_id, {a['at']} AS at FROM e)"
        else:
            found = f"(SELECT run_id, {'min' if a['kind'] == 'first' else 'max'}(t) AS at FROM {source} WHERE {where} GROUP BY run_id)"
        parts.append(f"a{i} AS (SELECT p.*, f.at AS \"{a['name']}\" FROM {known} p LEFT JOIN {found} f ON f.run_id = p.run_id)")
    parts.append(f"anchors AS (SELECT * FROM a{len(anchors)})")
    return ", ".join(parts)


def use_case_sql(name, msg, views, runs):
    """`runs` gives the parameters of a run as name: SQL over msg; they are columns of every view."""
    from .expected import ANCHORS, METRICS

    ctes = [msg, "runs AS (SELECT run_id, " + ", ".join(f"any_value({sql}) AS {n}" for n, sql in runs.items()) + " FROM msg GROUP BY run_id)"]
    ctes += [f'"{view}" AS (SELECT v.*, {", ".join(f"runs.{p}" for p in runs)} FROM ({sql}) v JOIN runs USING (run_id))' for view, sql in views.items()]
    ctes.append(anchors_sql(ANCHORS[name]))
    ctes += [f"m{i} AS ({sql})" for i, (_, sql) in enumerate(METRICS[name])]
    every = " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric_id, CAST(value AS DOUBLE) AS value, passed FROM m{i}" for i, (m, _) in enumerate(METRICS[name]))
    ids = ", ".join(f"('{m}')" for m, _ in METRICS[name])
    return f"""WITH {', '.join(ctes)}, every AS ({every}), wanted AS (SELECT run_id, metric_id FROM a0, (VALUES {ids}) AS i(metric_id))
SELECT '{name}' AS use_case, w.run_id, w.metric_id, e.value, CASE WHEN e.passed IS NULL THEN 'not_evaluated' WHEN e.passed THEN 'passed' ELSE 'failed' END AS verdict
FROM wanted w LEFT JOIN every e ON e.run_id = w.run_id AND e.metric_id = w.metric_id"""
