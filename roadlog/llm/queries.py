"""The op queries: each applies one operator to its whole table; SQL where the result can be said in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlog import session
from roadlog.llm import decontaminate, divergence, exact, lines, lm, mixing, mjpeg, pii, rlz, search, secrets, simhash, toxicity
from roadlog.llm.common import cut, load

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}

# the words of a text in DuckDB
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def digest(names: str) -> F.Column:
    """SHA-256 of a list of strings, sorted and joined by commas."""
    return F.sha2(F.array_join(F.sort_array(names), ",").cast("binary"), 256)


MIX_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
s1 AS (SELECT *, CASE n % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS room, 2 * source_size / weight AS r, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s1),
s3 AS (SELECT *, (budget - (sum(room) OVER (ORDER BY r, source NULLS LAST) - room)) / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, budget, least(room, coalesce((SELECT arg_min(level, r) FROM s3 WHERE level <= r) * weight, room)) AS target FROM s3),
q AS (SELECT d.doc_id, d.source, d.size, d.u, s.source_size, s.target, s.budget,
 CAST(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
 FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
i AS (SELECT *, CASE WHEN target > 0 THEN (source_size * copy + upto) / target ELSE 0 END AS finish
 FROM q CROSS JOIN (VALUES (0), (1)) AS c(copy)),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, coalesce('s' || source, 'n'), u, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS takes FROM i)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(CASE WHEN takes THEN size ELSE 0 END) AS BIGINT) AS taken
FROM t GROUP BY doc_id, source, size, u, upto"""


@query("op6_mixing", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.cut(mixing.sized(load(spark, sf_dir, "documents")))
    sources = mixing.targets(mixing.cyclic_weights(mixing.source_sizes(rows)))
    mixed = mixing.mix(rows, mixing.cut(sources))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAK_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT m FROM bw))),
h AS (SELECT r, p, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS pos FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, array_to_string(list(item_id ORDER BY item_id), ',') AS names FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""


@query("op9_decontamination", LEAK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        digest("items").alias("items_sha256"), (hit > 0).alias("contaminated"))


_LINES = r"string_split(coalesce(text, ''), chr(10))"
LINE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LINES} AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY r"""


@query("op5_line_dedup", LINE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.remove(docs)
    return kept.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = simhash.cut(simhash.signed(load(spark, sf_dir, "documents"), size=3))
    found = simhash.classes(signs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_mjpeg")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mjpeg.described(load(spark, sf_dir, "documents"))
    shots = F.array_join(F.zip_with("starts", "ends", lambda s, e: F.concat_ws("-", s.cast("string"), e.cast("string"))), ",")
    feature = F.concat(F.lit("clips="), F.size("starts").cast("string"), F.lit(";frames="), shots)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def _listed(found: DataFrame, base: list[str]) -> dict[str, F.Column]:
    """Counts per kind, the digest of the spans of these kinds and the text of all spans."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    named = lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))
    counts = {f"n_{k}": F.size(F.expr(f"filter(kinds, x -> x = '{k}')")).cast("long") for k in base}
    fixed = F.array_join(F.transform(F.filter(spans, lambda s: s["kinds"].isin(base)), named), ",")
    return {**counts, "base_sha256": F.sha2(fixed.cast("binary"), 256), "spans": F.array_join(F.transform(spans, named), ",")}


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(n) for n, c in _listed(found, ["assign", "access", "hex"]).items()])


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(n) for n, c in _listed(found, ["email", "ip", "card", "phone"]).items()])


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


REPEAT_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
m AS (SELECT *, min((doc_id, p)) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS pos FROM m WHERE first < (doc_id, p)),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM x ANTI JOIN c USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


@query("op2_rlz", REPEAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz.parse(load(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LM_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS ws FROM documents),
q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
m AS (SELECT r, CASE WHEN doc_id IN (SELECT doc_id FROM q WHERE doc_id IS NOT NULL) THEN 1 ELSE 0 END AS mine, len(ws) AS n FROM d),
t AS (SELECT r, p, ws[p] AS w, CASE WHEN p = 1 THEN '' ELSE ws[p - 1] END AS u FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
s AS (SELECT count(*) AS docs_b, sum(mine) AS docs_t, sum(n) AS words_b, sum(n * mine) AS words_t FROM m WHERE n > 0),
ob AS (SELECT r, u, w, count(*) AS n FROM t GROUP BY r, u, w), ow AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
cb AS (SELECT u, w, sum(ob.n) AS b, sum(ob.n * mine) AS t FROM ob JOIN m USING (r) GROUP BY u, w),
cw AS (SELECT w, sum(o.n) AS b, sum(o.n * mine) AS t FROM ow o JOIN m USING (r) GROUP BY w),
x AS (SELECT t.r, m.n, cb.b - ob.n AS bb, cb.t - ob.n * mine AS bt, cw.b - ow.n AS wb, cw.t - ow.n * mine AS wt,
 CASE WHEN t.u = '' THEN docs_b - 1 ELSE cu.b - ou.n END AS ub, CASE WHEN t.u = '' THEN docs_t - mine ELSE cu.t - ou.n * mine END AS ut,
 words_b - m.n AS tb, words_t - m.n * mine AS tt
 FROM t JOIN m USING (r) JOIN ob ON ob.r = t.r AND ob.u = t.u AND ob.w = t.w JOIN cb ON cb.u = t.u AND cb.w = t.w
 JOIN ow ON ow.r = t.r AND ow.w = t.w JOIN cw ON cw.w = t.w LEFT JOIN ow ou ON ou.r = t.r AND ou.w = t.u LEFT JOIN cw cu ON cu.w = t.u CROSS JOIN s),
l AS (SELECT r, sum(-ln((bt + 10.0::DOUBLE * (wt + 0.05::DOUBLE) / (tt + 0.05::DOUBLE * 1048576)) / (ut + 10.0::DOUBLE))) / any_value(n) AS lt,
 sum(-ln((bb + 10.0::DOUBLE * (wb + 0.05::DOUBLE) / (tb + 0.05::DOUBLE * 1048576)) / (ub + 10.0::DOUBLE))) / any_value(n) AS lb FROM x GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(lt, 0) + 1e-9, 6) + 0.0 AS loss_target, round(coalesce(lb, 0) + 1e-9, 6) + 0.0 AS loss_background,
 round(coalesce(lb - lt, 0) + 1e-9, 6) + 0.0 AS score FROM d LEFT JOIN l USING (r)"""


@query("op8_cross_entropy", LM_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = load(spark, sf_dir, "labels").filter("quality = 1")
    scored = lm.score(load(spark, sf_dir, "documents"), target)
    rounded = [(F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c) for c in ("loss_target", "loss_background", "score")]
    return scored.select("doc_id", "n_words", *rounded)


AUDIT_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS words, sum(lang_n) AS lang_n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.words) AS p,
 1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (v.lang_n + 2 * v.words) AS q
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
 LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
e AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
 FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(e.value, 0) AS value
 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN e ON e.lang = x.lang AND e.source = x.source AND e.item = y.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM a WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10"""


@query("op11_divergence", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


COPY_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, hash(coalesce(text, '')) AS h,
 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS k FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, doc_id NULLS LAST, h) AS place FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY place) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, place = 1 AS kept,
 k AS text_sha256 FROM p"""


@query("op12_exact", COPY_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(exact.digested(load(spark, sf_dir, "documents")))
    path = session.written(spark, f"{session.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    decided = exact.DigestIndex.create(spark, path, rows.count()).absorb(rows, "documents")
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
c AS (SELECT count(*) AS docs, sum(len(ws)) AS length FROM d WHERE len(ws) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, count(*) AS df FROM t GROUP BY term),
x AS (SELECT item_id, d.r, d.doc_id, sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT)
 * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * docs) // length)))) AS score
 FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (r) CROSS JOIN c GROUP BY item_id, d.r, d.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""


@query("op13_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
