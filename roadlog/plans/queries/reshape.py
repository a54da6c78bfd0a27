"""Queries of the typing, reshaping and decoding family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import clock, geo, text, units
from ...operators import reshape
from ..registry import EV, load, messages, micros, query

RUN, T, SEQ = ["run_id"], "t", ["seq"]


@query("mapping_etl", "order_id:i customer:s status:s total:f day:s labels:s", """
SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_totalprice AS total,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, '["' || array_to_string(string_split(o_orderpriority, '-'), '","') || '"]' AS labels FROM orders""")
def mapping_etl(spark, sf):
    raw = load(spark, sf, "orders").withColumn("labels", F.split("o_orderpriority", "-")).withColumn("empty", F.lit(None))
    mapped = reshape.apply_mapping(raw, [
        ("o_orderkey", "long", "order_id", "long"), ("o_custkey", "long", "customer", "string"),
        ("o_orderstatus", "string", "status", "string"), ("o_totalprice", "double", "total", "double"),
        ("o_orderdate", "timestamp", "day", "string"), ("labels", "array", "labels", "string")])
    return reshape.drop_null_fields(mapped)


@query("resolve_choice", "event_id:i mixed_long:i mixed_double:f mixed_string:s", """
SELECT event_id, CASE event_type WHEN 'click' THEN user_id END AS mixed_long, CASE event_type WHEN 'view' THEN value + 0.001 END AS mixed_double,
 CASE WHEN event_type NOT IN ('click', 'view') THEN 'x' || event_type END AS mixed_string FROM events""")
def resolve_choice(spark, sf):
    e = load(spark, sf, "events")
    mixed = (F.when(F.col("event_type") == "click", F.col("user_id").cast("string"))
             .when(F.col("event_type") == "view", F.format_string("%.3f", F.col("value") + 0.001)).otherwise(F.concat(F.lit("x"), "event_type")))
    return reshape.resolve_choice(e.select("event_id", mixed.alias("mixed")), {"mixed": ["long", "double", "string"]})


@query("null_fields", "field:s n:i", """
SELECT 'doc_id' AS field, count(*) AS n FROM labels UNION ALL SELECT 'quality', count(quality) FROM labels UNION ALL SELECT 'toxic', count(toxic) FROM labels""")
def null_fields(spark, sf):
    labels = load(spark, sf, "labels").withColumn("void", F.lit(None)).withColumn("blank", F.lit(None).cast("string"))
    kept = reshape.drop_null_fields(labels, check_values=True)
    counted = kept.agg(*[F.count(c).alias(c) for c in kept.columns])
    return counted.unpivot([], kept.columns, "field", "n")


@query("flatten_pairs", "event_id:i topic:s speed:f note:s empty:s", """
SELECT event_id, event_type AS topic, value AS speed, CASE WHEN event_type = 'error' THEN 'a:b' END AS note, CAST(NULL AS VARCHAR) AS empty FROM events""")
def flatten_pairs(spark, sf):
    e = load(spark, sf, "events")
    printed = F.concat(F.lit("header:\n  topic: "), "event_type", F.lit("\n  speed: "), F.col("value").cast("string"),
                       F.when(F.col("event_type") == "error", "\nnote: a:b").otherwise(""), F.lit("\nempty:"))
    out = reshape.flatten_pairs(e.select("event_id", printed.alias("msg")), ["event_id"], "msg", ["topic", "speed", "note", "empty"])
    return out.withColumn("speed", F.col("speed").cast("double"))


@query("nested_objects", "vec_id:i place:i object_id:i weight:f", """
SELECT vec_id, unnest(range(0, len(embedding))) AS place, unnest(range(0, len(embedding))) + 1000 AS object_id, unnest(embedding) AS weight FROM embeddings""")
def nested_objects(spark, sf):
    objects = F.transform("embedding", lambda v, i: F.struct((i + 1000).alias("object_id"), v.alias("weight")))
    return reshape.explode_objects(load(spark, sf, "embeddings").withColumn("objects", objects), "objects", ["vec_id"], "place")


@query("object_with_id", "vec_id:i place:i weight:f", """
SELECT vec_id, label AS place, embedding[label + 1] AS weight FROM embeddings""")
def object_with_id(spark, sf):
    e = load(spark, sf, "embeddings")
    objects = F.transform("embedding", lambda v, i: F.struct(i.alias("id"), v.alias("w")))
    picked = e.withColumn("objects", objects).withColumn("o", reshape.object_with_id("objects", "id", F.col("label")))
    return picked.select("vec_id", F.col("label").alias("place"), F.col("o.w").alias("weight"))


@query("enum_decode", "event_id:i state:i label:s known:b", f"""
WITH {EV} SELECT seq AS event_id, k % 8 AS state, CASE k % 8 WHEN 2 THEN 'leader_waiting' WHEN 3 THEN 'candidate' WHEN 4 THEN 'leader' WHEN 5 THEN 'follower' ELSE 'other' END AS label,
 k % 8 BETWEEN 2 AND 5 AS known FROM ev""")
def enum_decode(spark, sf):
    state = (F.col("k") % 8).alias("state")
    rows = messages(spark, sf).select(F.col("seq").alias("event_id"), state)
    label = text.decode(F.col("state").cast("int"), {2: "leader_waiting", 3: "candidate", 4: "leader", 5: "follower"})
    return rows.withColumn("label", label).withColumn("known", F.col("label") != "other")


@query("id_normalise", "l_orderkey:i object_id:i n:i", "SELECT l_orderkey, l_orderkey % 1000 AS object_id, count(*) AS n FROM lineitem GROUP BY ALL")
def id_normalise(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_orderkey") % 1000).alias("object_id")).agg(F.count(F.lit(1)).alias("n"))


@query("unit_convert", "event_id:i mps:f mph:f feet:f metres:f dead:f clamped:f mirrored:f", """
SELECT event_id, value * 0.277777 AS mps, value * 0.277777 * 2.23694 AS mph, value * 3.28084 AS feet, value * 0.1 AS metres,
 CASE WHEN abs(value - 50) < 10 THEN 0 ELSE value - 50 END AS dead, greatest(20, least(80, value)) AS clamped, (360 - value) - 360 * floor((360 - value) / 360) AS mirrored FROM events""")
def unit_convert(spark, sf):
    v = F.col("value")
    return load(spark, sf, "events").select(
        "event_id", units.kph_to_mps(v).alias("mps"), units.mps_to_mph(units.kph_to_mps(v)).alias("mph"), units.metres_to_feet(v).alias("feet"),
        units.decimetres_to_metres(v).alias("metres"), units.dead_band(v - 50, 10).alias("dead"), units.clamp(v, 20, 80).alias("clamped"),
        geo.heading_mirror(v).alias("mirrored"))


@query("map_frame", "event_id:i x:f y:f", """
SELECT event_id, -(CAST(json_extract(props, '$.k') AS DOUBLE)) + s_acctbal / 100 AS x, value AS y FROM events JOIN supplier ON s_suppkey = user_id % (SELECT count(*) FROM supplier)""")
def map_frame(spark, sf):
    # axes turned by 90 degrees, then moved by the position of the sensor that saw the object
    rows = messages(spark, sf)
    sensors = load(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x0"))
    n = sensors.agg(F.count(F.lit(1)).alias("n_sensors"))
    placed = rows.crossJoin(F.broadcast(n)).join(sensors, F.col("run_id") % F.col("n_sensors") == F.col("s_suppkey"))
    return placed.select(F.col("seq").alias("event_id"), (-F.col("k").cast("double") + F.col("x0")).alias("x"), F.col("value").alias("y"))


@query("clock_forms", "event_id:i moy_ms:i struct_ms:i gps:i day_ms:i", """
SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS moy_ms, epoch_us(ts) // 1000 AS struct_ms, epoch_us(ts) // 1000 AS gps, (epoch_us(ts) // 1000) % 86400000 AS day_ms FROM events""")
def clock_forms(spark, sf):
    us = micros("ts")
    ms = F.floor(us / 1000).cast("long")
    e = load(spark, sf, "events").select("event_id", "ts", us.alias("us"), ms.alias("ms"))
    moy = (F.dayofyear("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    parts = F.struct(F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
                     F.minute("ts").alias("minute"), (F.col("ms") % 60000).alias("second"))
    second = F.floor(F.col("ms") / 1000) % 60
    of_day = F.concat_ws(":", F.hour("ts"), F.minute("ts"), F.concat(second.cast("string"), F.lit(","), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")))
    seconds_in_day = (F.col("ms") % 86_400_000) / 1000.0
    return e.select("event_id", clock.minute_of_year_ms(moy, second * 1000, 2024, "UTC").alias("moy_ms"), clock.date_struct_ms(parts).alias("struct_ms"),
                    clock.gps_ms(F.date_format("ts", "ddMMyy"), seconds_in_day).alias("gps"), clock.time_of_day_ms(of_day).alias("day_ms"))


@query("clock_offset", "run_id:i seq:i t_ms:i", f"""
WITH {EV}, o AS (SELECT run_id, min(t) AS t0 FROM ev WHERE topic = 'signup' GROUP BY run_id)
SELECT run_id, seq, CAST(round((t - t0) / 1000.0) AS BIGINT) AS t_ms FROM ev JOIN o USING (run_id) WHERE t >= t0""")
def clock_offset(spark, sf):
    rows = messages(spark, sf)
    offsets = rows.where("topic = 'signup'").groupBy("run_id").agg(F.min("t").alias("t0"))
    moved = rows.join(offsets, "run_id").withColumn("t_ms", clock.shift_ms(F.col("t") / 1000.0, F.col("t0") / 1000.0))
    return moved.where(F.col("t_ms").isNotNull())


@query("status_decode", "event_id:i approaching:b seconds:f action:s lane:i", f"""
WITH {EV} SELECT seq AS event_id, k > 50 AS approaching, value AS seconds, topic AS action, k AS lane FROM ev""")
def status_decode(spark, sf):
    status = F.concat(F.lit("APPROACHING: "), F.when(F.col("k") > 50, "1").otherwise("0"), F.lit(",TIME_UNTIL:"), F.col("value").cast("string"),
                      F.lit(", ACTION :"), "topic", F.lit(",LANE:"), F.col("k").cast("string"))
    rows = messages(spark, sf).select(F.col("seq").alias("event_id"), status.alias("m"))
    m = lambda name: text.field_of(F.col("m"), name)
    return rows.select("event_id", (m("APPROACHING") == "1").alias("approaching"), m("TIME_UNTIL").cast("double").alias("seconds"),
                       m("ACTION").alias("action"), m("LANE").cast("long").alias("lane"))


@query("xml_extract", "event_id:i has_part:b siren:b light:b emergency:s speed:f", f"""
WITH {EV} SELECT seq AS event_id, topic <> 'error' AS has_part, topic <> 'error' AND k < 30 AS siren, topic <> 'error' AND k < 60 AS light,
 CASE WHEN topic = 'signup' THEN 'emergency' ELSE '' END AS emergency, value AS speed FROM ev""")
def xml_extract(spark, sf):
    when = lambda c, xml: F.when(c, xml).otherwise("")
    alerts = F.concat(F.lit("<vehicleAlerts>"), when(F.col("k") < 30, "<sirenUse><inUse/></sirenUse>"), when(F.col("k") < 60, "<lightsUse><inUse/></lightsUse>"),
                      when(F.col("topic") == "signup", "<responseType>emergency</responseType>"), F.lit("</vehicleAlerts>"))
    part = F.when(F.col("topic") != "error", F.concat(F.lit("<partII><Value>"), alerts, F.lit("</Value></partII>"))).otherwise("")
    xml = F.concat(F.lit("<BasicSafetyMessage><coreData><speed>"), F.col("value").cast("string"), F.lit("</speed></coreData>"), part, F.lit("</BasicSafetyMessage>"))
    rows = messages(spark, sf).select(F.col("seq").alias("event_id"), xml.alias("xml"))
    # a row without the tag at all needs no parsing
    has = lambda path: F.col("xml").contains(f"<{path.split('/')[-2]}>") & F.xpath_boolean("xml", F.lit(path))
    return rows.select("event_id", has("/BasicSafetyMessage/partII/Value").alias("has_part"), has("//vehicleAlerts/sirenUse/inUse").alias("siren"),
                       has("//vehicleAlerts/lightsUse/inUse").alias("light"), F.when(F.col("xml").contains("<responseType>"), F.xpath_string("xml", F.lit("//vehicleAlerts/responseType"))).otherwise("").alias("emergency"),
                       F.regexp_extract("xml", "<coreData><speed>([^<]*)</speed>", 1).try_cast("double").alias("speed"))


@query("hex_id", "event_id:i reqid:s", f"""
WITH {EV} SELECT seq AS event_id, lower(lpad(to_hex(k), 2, '0')) || lower(lpad(to_hex(run_id % 256), 2, '0')) || '10' AS reqid FROM ev""")
def hex_id(spark, sf):
    data = F.array(F.col("k"), F.col("run_id") % 256, F.lit(16))
    return messages(spark, sf).select(F.col("seq").alias("event_id"), text.hex_id(data).alias("reqid"))


@query("json_in_string", "event_id:i operation:s longitude:f cargo:s", f"""
WITH {EV} SELECT seq AS event_id, topic AS operation, value AS longitude, CASE WHEN k > 50 THEN 'c' || k END AS cargo FROM ev""")
def json_in_string(spark, sf):
    cargo = F.when(F.col("k") > 50, F.concat(F.lit(", 'cargo_id': 'c"), F.col("k").cast("string"), F.lit("'"))).otherwise("")
    params = F.concat(F.lit("{'operation': '"), "topic", F.lit("', 'destination': {'longitude': "), F.col("value").cast("string"), F.lit("}"), cargo, F.lit("}"))
    rows = messages(spark, sf).select(F.col("seq").alias("event_id"), F.regexp_replace(params, "'", '"').alias("params"))
    message = F.from_json("params", "operation string, destination struct<longitude: double>, cargo_id string")
    return rows.withColumn("m", message).select("event_id", "m.operation", "m.destination.longitude", F.col("m.cargo_id").alias("cargo"))


@query("json_first", "event_id:i first_k:i n:i", f"WITH {EV} SELECT seq AS event_id, k AS first_k, 2 AS n FROM ev")
def json_first(spark, sf):
    document = F.concat(F.lit('[{"location": {"k": '), F.get_json_object("props", "$.k"), F.lit('}}, {"location": {"k": -1}}]'))
    rows = load(spark, sf, "events").select("event_id", F.from_json(document, "array<struct<location: struct<k: long>>>").alias("d"))
    return rows.select("event_id", F.col("d")[0]["location"]["k"].alias("first_k"), F.size("d").alias("n"))


@query("component_name", "url:s component:s", """
SELECT url, CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%/fr/%' THEN 'french' WHEN url LIKE '%/de/%' THEN 'german' ELSE 'unknown' END AS component FROM pages""")
def component_name(spark, sf):
    rules = [(F.col("url").contains(f"/{code}/"), name) for code, name in (("en", "english"), ("fr", "french"), ("de", "german"))]
    return load(spark, sf, "pages").select("url", text.first_rule(rules, F.lit("unknown")).alias("component"))


@query("callback_stats", "p_brand:s description:s mean:f min:f median:f max:f std:f count:i", """
WITH a AS (SELECT p_brand, CASE WHEN p_name LIKE '%ring%' THEN 'ring callback' WHEN p_name LIKE '%widget%' THEN 'widget callback' WHEN p_type LIKE '%ECONOMY%' THEN 'economy callback'
 ELSE '' END AS description, l_extendedprice AS d FROM lineitem JOIN part ON p_partkey = l_partkey
 WHERE (p_name LIKE '%small%' OR p_type LIKE '%small%' OR p_name LIKE '%red%' OR p_type LIKE '%red%') AND NOT (p_name LIKE '%bolt%' OR p_type LIKE '%bolt%') AND l_shipdate > TIMESTAMP '1996-01-01')
SELECT p_brand, description, avg(d) AS mean, min(d) AS min, quantile_cont(d, 0.5) AS median, max(d) AS max, stddev_samp(d) AS std, count(d) AS count FROM a GROUP BY ALL""")
def callback_stats(spark, sf):
    from ...operators.stats import group_stats

    wanted = text.any_of(F.col("p_name"), ["small", "red"]) | text.any_of(F.col("p_type"), ["small", "red"])
    ignored = text.any_of(F.col("p_name"), ["bolt"]) | text.any_of(F.col("p_type"), ["bolt"])
    parts = load(spark, sf, "part").where(wanted & ~ignored)
    description = text.last_rule([(F.col("p_type").contains("ECONOMY"), "economy callback"), (F.col("p_name").contains("widget"), "widget callback"),
                                  (F.col("p_name").contains("ring"), "ring callback")], F.lit(""))
    calls = load(spark, sf, "lineitem").where(F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    joined = calls.join(parts.withColumn("description", description), F.col("l_partkey") == F.col("p_partkey"))
    return group_stats(joined, ["p_brand", "description"], "l_extendedprice")


@query("data_dictionary", "topic:s field:s type:s", """
SELECT event_type AS topic, 'k' AS field, 'long' AS type FROM events GROUP BY event_type""")
def data_dictionary(spark, sf):
    e = load(spark, sf, "events").withColumnRenamed("event_type", "topic")
    return reshape.payload_dictionary(e, "topic", "props", "ts", "event_id")


@query("merged_columns", "key:i o_custkey:i s_name:s", """
SELECT o_orderkey AS key, o_custkey, CAST(NULL AS VARCHAR) AS s_name FROM orders UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""")
def merged_columns(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    return reshape.align_columns([orders, suppliers])


@query("array_tools", "vec_id:i low:f high:f n_distinct:i flat:i", """
SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high, len(list_distinct(embedding)) AS n_distinct, 2 * len(embedding) AS flat FROM embeddings""")
def array_tools(spark, sf):
    flat = F.flatten(F.array("embedding", "embedding"))
    return load(spark, sf, "embeddings").select("vec_id", F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"),
                                                F.size(F.array_distinct("embedding")).alias("n_distinct"), F.size(flat).alias("flat"))


@query("string_tools", "page_id:i host:s digits:s n_parts:i plain:s", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[^0-9]', '', 'g') AS digits, len(string_split(url, '/')) AS n_parts,
 trim(lower(replace(url, 'http://', ''))) AS plain FROM pages""")
def string_tools(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), text.digits(F.col("url")).alias("digits"),
                                           F.size(F.split("url", "/")).alias("n_parts"), F.trim(F.lower(F.replace("url", F.lit("http://"), F.lit("")))).alias("plain"))


@query("required_deceleration", "run_id:i seq:i rate:f passed:b", f"""
WITH {EV} SELECT run_id, seq, (400 - value * value) / nullif(2.0 * k, 0) AS rate, (400 - value * value) / nullif(2.0 * k, 0) >= -2 AS passed FROM ev""")
def required_deceleration(spark, sf):
    rate = units.required_rate(F.col("value"), F.lit(20.0), F.col("k").cast("double"))
    return messages(spark, sf).withColumn("rate", rate).withColumn("passed", F.col("rate") >= -2)


@query("tolerant_compare", "run_id:i n_close:i n_band:i", f"""
WITH {EV} SELECT run_id, count(*) FILTER (abs(value - k) < 5) AS n_close, count(*) FILTER (value BETWEEN k - 10 AND k + 10) AS n_band FROM ev GROUP BY run_id""")
def tolerant_compare(spark, sf):
    k = F.col("k")
    return messages(spark, sf).groupBy("run_id").agg(F.count_if(units.close_to(F.col("value"), k, 5)).alias("n_close"),
                                                     F.count_if(F.col("value").between(k - 10, k + 10)).alias("n_band"))
