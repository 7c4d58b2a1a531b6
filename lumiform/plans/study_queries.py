"""The catalogue's second part: standardisation study, result tables, geometry, logs, manifests and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.functions import text as T
from lumiform.functions.ranking import average_ranks
from lumiform.functions.render import FORMATS
from lumiform.operators import answer, effect, scorers, study
from lumiform.operators.corpus import hashed
from lumiform.plans.base import HELD, PAIRS, REN, STUDY, TWO, gold_scores, gold_sql, grids, h, led, led_sql, rendered, tens, tensor_sql
from lumiform.plans.queries import query
from lumiform.sources import readers
from lumiform.sources.readers import table
from lumiform.sources.scratch import shared_folder
from lumiform.streaming.ingest import available_counts

_MIXED = f"{h(chr(39) + '3' + chr(39), chr(39) + 'mixed' + chr(39), 'query_id', 'cand')} % 5"


@query(f"WITH {tensor_sql()} SELECT query_id, cand, format, round(score, 6) AS score FROM tensor WHERE fpos = {_MIXED}")
def mixed_assignment(spark, d):
    return study.assign_mixed(tens(spark, d)).select("query_id", "cand", "format", "score")


@query(f"WITH {tensor_sql()} SELECT cand, round(avg(score), 6) AS mean, count(*) AS n FROM tensor WHERE format = 'json' GROUP BY 1")
def uniform_assignment(spark, d):
    return study.assign_uniform(tens(spark, d), "json").groupBy("cand").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {tensor_sql(TWO)}, r AS (SELECT * FROM tensor WHERE fpos = {_MIXED}), g AS (SELECT arm, query_id, max(score) FILTER (cand = 0) AS g FROM r GROUP BY ALL), a AS (SELECT r.arm, r.query_id, count(*) FILTER (cand > 0 AND score > g) AS above FROM r JOIN g USING (arm, query_id) GROUP BY ALL) SELECT arm, round(avg(1.0::DOUBLE / (1 + above)), 6) AS mrr, round(avg((above = 0)::INT), 6) AS top1 FROM a GROUP BY 1")
def mixed_quality(spark, d):
    return study.quality(study.assign_mixed(tens(spark, d, TWO)), ("arm",))


_ML = """ml AS (SELECT t.model, t.arm, t.seed, t.query_id, gf, product(share) AS pr FROM (SELECT n.model, n.arm, n.seed, n.query_id, n.cand, g.format AS gf, avg((n.score <= g.score)::INT) AS share FROM tensor n JOIN tensor g ON n.model = g.model AND n.arm = g.arm AND n.seed = g.seed AND n.query_id = g.query_id AND g.cand = 0 WHERE n.cand > 0 GROUP BY ALL) t GROUP BY ALL),
mx AS (SELECT model, arm, seed, query_id, avg(pr) AS p FROM ml GROUP BY ALL)"""


@query(f"WITH {tensor_sql(TWO)}, {_ML} SELECT arm, query_id, round(p, 6) AS p FROM mx")
def mixed_lead_exact(spark, d):
    return study.mixed_lead(tens(spark, d, TWO)).select("arm", "query_id", "p")


@query(f"WITH {led_sql(TWO)}, c AS (SELECT arm, query_id, count(*) FILTER (lead) AS k FROM led GROUP BY ALL), a AS (SELECT arm, avg((k = 5)::INT) AS floor, avg((k > 0)::INT) AS ceiling FROM c GROUP BY 1), b AS (SELECT arm, max(s) AS best FROM (SELECT arm, format, avg(lead::INT) AS s FROM led GROUP BY ALL) GROUP BY 1) SELECT arm, round(floor, 6) AS floor, round(best, 6) AS best, round(ceiling, 6) AS ceiling, round(ceiling - best, 6) AS headroom FROM a JOIN b USING (arm)")
def oracle_band(spark, d):
    return study.oracle_band(led(spark, d, TWO), ("arm",))


_M2 = [("m1", "untrained", 0, 60, 4), ("m2", "untrained", 0, 72, 4)]
_MARGIN = "mg AS (SELECT model, query_id, max(m) FILTER (cand = 0) - max(m) FILTER (cand > 0) AS margin FROM (SELECT model, query_id, cand, avg(score) AS m FROM tensor GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {tensor_sql(_M2)}, {_MARGIN} SELECT model, query_id, round(margin, 6) AS margin FROM mg")
def format_margins(spark, d):
    return study.margins(tens(spark, d, _M2), ("model",))


@query(f"""WITH {tensor_sql(_M2)}, {_MARGIN}, r AS (SELECT model, query_id, (rank() OVER (PARTITION BY model ORDER BY round(margin, 9)) + (count(*) OVER (PARTITION BY model, round(margin, 9)) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS share FROM mg),
s AS (SELECT query_id, round(avg(share), 9) AS share FROM r GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY share, query_id) AS place, count(*) OVER () AS n FROM s) SELECT query_id, round(share, 6) AS share FROM o WHERE place <= floor(n * 0.25::DOUBLE)""")
def hard_subset(spark, d):
    return study.hard_subset(study.margins(tens(spark, d, _M2), ("model",)))


_POL = _ML + """, bf AS (SELECT model, arm, seed, arg_max(format, (round(s, 9), -fpos)) AS best_format FROM (SELECT model, arm, seed, format, fpos, avg(lead::INT) AS s FROM led GROUP BY ALL) GROUP BY ALL),
pol AS (SELECT l.model, l.arm, l.seed, l.query_id, avg(lead::INT) AS mean, max(lead::INT) FILTER (format = best_format) AS best, any_value(p) AS mixed FROM led l JOIN bf USING (model, arm, seed) JOIN mx USING (model, arm, seed, query_id) GROUP BY ALL)"""


def _policies(spark, d):
    told = study.led_and_mixed(grids(spark, d, STUDY))
    return study.policies(answer.leads_in(told, "leads", study.TENSOR_KEYS), told.select(*study.TENSOR_KEYS, "query_id", "p"))


@query(f"WITH {led_sql(STUDY)}, {_POL} SELECT model, arm, round(avg(mean), 6) AS standardised_mean, round(avg(best), 6) AS standardised_best, round(avg(mixed), 6) AS mixed FROM pol GROUP BY ALL")
def levels_table(spark, d):
    return study.levels(_policies(spark, d))


_FT = ", ".join(f"round(avg(lead::INT) FILTER (format = '{f}'), 6) AS {f}" for f in FORMATS)
_G = "greatest(" + ", ".join(f"avg(lead::INT) FILTER (format = '{f}')" for f in FORMATS) + ")"


@query(f"WITH {led_sql(STUDY)} SELECT model, {_FT}, round({_G} - {_G.replace('greatest', 'least')}, 6) AS range FROM led WHERE arm = 'untrained' GROUP BY 1")
def format_table(spark, d):
    return study.format_table(led(spark, d, STUDY), "untrained")


@query(f"WITH {led_sql(STUDY)} SELECT model, format, round(avg(lead::INT) FILTER (arm = 'untrained'), 6) AS untrained, round(avg(lead::INT) FILTER (arm = 'control'), 6) AS control, round(avg(lead::INT) FILTER (arm = 'winner'), 6) AS winner FROM led GROUP BY ALL")
def standardised_table(spark, d):
    return led(spark, d, STUDY).groupBy("model", "format").pivot("arm", ["untrained", "control", "winner"]).agg(F.avg(F.col("lead").cast("int")))


_SEEDS = f"WITH {led_sql(STUDY)}, s AS (SELECT model, seed, avg(lead::INT) FILTER (arm = 'winner') - avg(lead::INT) FILTER (arm = 'control') AS ch FROM led WHERE arm <> 'untrained' GROUP BY ALL)"


@query(f"{_SEEDS}, m AS (SELECT model, avg(ch) AS mean FROM s GROUP BY 1) SELECT model, round(any_value(mean), 6) AS mean, round(stddev_samp(ch), 6) AS sd, count(*) FILTER (sign(ch) = sign(mean)) AS agree, count(*) AS seeds FROM s JOIN m USING (model) GROUP BY 1")
def seed_table(spark, d):
    return study.seed_table(led(spark, d, STUDY).filter("arm <> 'untrained'"), "winner", "control")


@query(f"{_SEEDS} SELECT model, round(avg(ch), 6) AS mean, round(coalesce(stddev_samp(ch), 0), 6) AS sd, round(min(ch), 6) AS least, round(max(ch), 6) AS most FROM s GROUP BY 1")
def seed_spread(spark, d):
    side = lambda a: F.avg(F.when(F.col("arm") == a, F.col("lead").cast("int")))
    s = led(spark, d, STUDY).filter("arm <> 'untrained'").groupBy("model", "seed").agg((side("winner") - side("control")).alias("ch"))
    return s.groupBy("model").agg(F.avg("ch").alias("mean"), F.coalesce(F.stddev_samp("ch"), F.lit(0.0)).alias("sd"), F.min("ch").alias("least"), F.max("ch").alias("most"))


@query(f"WITH {led_sql(STUDY)} SELECT model, round(avg(lead::INT) FILTER (arm = 'winner' AND format = '{HELD}') - avg(lead::INT) FILTER (arm = 'untrained' AND format = '{HELD}'), 6) AS {HELD}, round(avg(lead::INT) FILTER (arm = 'winner' AND format = 'yaml') - avg(lead::INT) FILTER (arm = 'untrained' AND format = 'yaml'), 6) AS yaml FROM led GROUP BY 1")
def fold_matrix(spark, d):
    s = led(spark, d, STUDY).filter(F.col("format").isin(HELD, "yaml")).groupBy("model", "format").agg((F.avg(F.when(F.col("arm") == "winner", F.col("lead").cast("int"))) - F.avg(F.when(F.col("arm") == "untrained", F.col("lead").cast("int")))).alias("change"))
    return s.groupBy("model").pivot("format", [HELD, "yaml"]).agg(F.first("change"))


@query(f"WITH {tensor_sql(TWO)} SELECT arm, count(*) AS cells, count(DISTINCT query_id) AS queries, count(DISTINCT cand) AS candidates, count(DISTINCT format) AS formats, 0 AS problems FROM tensor GROUP BY 1")
def tensor_axes(spark, d):
    t = tens(spark, d, TWO)
    bad = study.axis_problems(t).groupBy("arm").agg(F.count(F.lit(1)).alias("problems"))
    sizes = t.groupBy("arm").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("query_id").alias("queries"), F.count_distinct("cand").alias("candidates"), F.count_distinct("format").alias("formats"))
    return sizes.join(bad, "arm", "left").withColumn("problems", F.coalesce("problems", F.lit(0)))


# -- result tables


_E = f"WITH {gold_sql(STUDY)}{PAIRS}, e AS (SELECT model, arm, pair, ppos, \"left\", \"right\", avg(diff) / (stddev_pop(diff) + 1e-12) AS d FROM p GROUP BY ALL)"


def _effects(spark, d, arms=STUDY):
    return effect.pairwise_d(gold_scores(spark, d, arms), ["model", "arm", "seed", "record_id"], ("model", "arm"))


@query(f"{_E} SELECT model, arm, \"left\", \"right\", round(d, 6) AS d, round(abs(d), 6) AS abs_d FROM e")
def pairwise_table(spark, d):
    return _effects(spark, d).select("model", "arm", "left", "right", "d", F.abs("d").alias("abs_d"))


@query(f"{_E}, m AS (SELECT model, arm, max(abs(d)) AS m FROM e GROUP BY ALL) SELECT model, round(max(m) FILTER (arm = 'untrained'), 6) AS untrained, round(max(m) FILTER (arm = 'winner'), 6) AS winner, round((max(m) FILTER (arm = 'winner') - max(m) FILTER (arm = 'untrained')) / max(m) FILTER (arm = 'untrained'), 6) AS relative FROM m GROUP BY 1")
def score_table(spark, d):
    m = effect.max_abs_d(_effects(spark, d), ("model", "arm")).groupBy("model").pivot("arm", ["untrained", "winner"]).agg(F.first("max_abs_d"))
    return m.withColumn("relative", T.relative_change(F.col("untrained"), F.col("winner")))


@query(f"{_E}, m AS (SELECT model, arm, max(abs(d)) AS d FROM e GROUP BY ALL), b AS (SELECT model, max(d) FILTER (arm = 'untrained') AS b, max(d) FILTER (arm = 'winner') AS t FROM m GROUP BY 1), k AS (SELECT *, CASE WHEN b >= 0.8 THEN 3 WHEN b >= 0.5 THEN 2 WHEN b >= 0.2 THEN 1 ELSE 0 END AS kb, CASE WHEN t >= 0.8 THEN 3 WHEN t >= 0.5 THEN 2 WHEN t >= 0.2 THEN 1 ELSE 0 END AS kt FROM b) SELECT model, kb AS before, kt AS after, kt - kb AS crossed FROM k")
def cohen_bands(spark, d):
    m = effect.max_abs_d(_effects(spark, d), ("model", "arm")).groupBy("model").pivot("arm", ["untrained", "winner"]).agg(F.first("max_abs_d"))
    return m.select("model", T.band_rank(F.col("untrained")).alias("before"), T.band_rank(F.col("winner")).alias("after"), T.bands_crossed(F.col("untrained"), F.col("winner")).alias("crossed"))


@query(f"{_E}, l AS (SELECT model, arm, avg(lead::INT) AS top1 FROM (WITH {led_sql(STUDY)} SELECT * FROM led) GROUP BY ALL), m AS (SELECT model, arm, max(abs(d)) AS d FROM e GROUP BY ALL) SELECT model, arm, round(d, 6) AS max_abs_d, round(top1, 6) AS top1 FROM m LEFT JOIN l USING (model, arm)")
def both_axes(spark, d):
    top1 = led(spark, d, STUDY).groupBy("model", "arm").agg(F.avg(F.col("lead").cast("int")).alias("top1"))
    return effect.max_abs_d(_effects(spark, d), ("model", "arm")).select("model", "arm", "max_abs_d").join(top1, ["model", "arm"], "left")


@query(f"{_E}, r AS (SELECT model, arm, pair, rank() OVER (PARTITION BY model, arm ORDER BY round(d, 9)) + (count(*) OVER (PARTITION BY model, arm, round(d, 9)) - 1) / 2.0::DOUBLE AS rank FROM e) SELECT model, arm, pair, rank FROM r")
def within_model_ranks(spark, d):
    e = _effects(spark, d).withColumn("d", F.round("d", 9))
    return average_ranks(e, ["model", "arm"], "d").select("model", "arm", "pair", "rank")


@query(f"{_E}, w AS (SELECT pair, max(d) FILTER (model = 'm1') AS x, max(d) FILTER (model = 'm2') AS y FROM e WHERE arm = 'untrained' GROUP BY 1) SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM w")
def axis_correlation(spark, d):
    w = _effects(spark, d).filter("arm = 'untrained'").groupBy("pair").pivot("model", ["m1", "m2"]).agg(F.first("d"))
    return w.agg(F.count(F.lit(1)).alias("n"), effect.correlation("m1", "m2").alias("r"))


# -- logs, progress, manifests, ingestion


def _log_lines(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit('{"event": "'), "event_type", F.lit('", "step": '), (F.col("event_id") * 10).cast("string"), F.lit(', "value": '), F.round("value", 2).cast("string"), F.when(F.col("event_id") % 97 == 96, F.lit("")).otherwise(F.lit("}")))
    return e.select(F.col("event_id").alias("line_no"), F.col("user_id"), line.alias("value"))


@query("SELECT event_type AS event, count(*) AS n, max(event_id * 10) AS last_step FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 97 = 96) GROUP BY 1")
def log_tail_truncation(spark, d):
    log = readers.read_log(_log_lines(spark, d))
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))


@query("SELECT count(*) AS kept, coalesce(max(event_id * 10), 0) AS step FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 97 = 96) AND event_id * 10 <= 500")
def log_rewind(spark, d):
    kept = readers.rewind(readers.read_log(_log_lines(spark, d)), 500)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.max("step"), F.lit(0)).alias("step"))


@query("""SELECT event_id, event_id % 50 AS done, CASE WHEN event_id % 50 = 0 THEN 0 ELSE round((50 - event_id % 50) * value / (event_id % 50), 6) END AS eta, value::BIGINT // 3600 || ':' || lpad((value::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((value::BIGINT % 60)::VARCHAR, 2, '0') AS took,
repeat('#', (event_id % 50 * 20 // 50)::INT) || repeat('.', (20 - event_id % 50 * 20 // 50)::INT) AS bar FROM (SELECT event_id, floor(value) AS value FROM events)""")
def progress_lines(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor("value").cast("double").alias("value"))
    line = T.progress_line([("done", F.col("event_id") % 50), ("total", F.lit(50)), ("elapsed", F.col("value"))])
    m = T.parse_progress(line)
    e = e.select("event_id", m["done"].cast("long").alias("done"), m["total"].cast("long").alias("total"), m["elapsed"].cast("double").alias("elapsed"))
    return e.select("event_id", "done", T.eta_seconds(F.col("done"), F.col("total"), F.col("elapsed")).alias("eta"), T.duration(F.col("elapsed")).alias("took"), T.progress_bar(F.col("done"), F.col("total")).alias("bar"))


@query("SELECT user_id, count(*) AS jobs, count(*) FILTER (event_type = 'purchase') AS finished, round(max(value), 6) AS longest FROM events GROUP BY 1")
def job_states(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("event_type") == "purchase").alias("finished"), F.max("value").alias("longest"))


@query("""SELECT p_partkey AS id, CASE WHEN length(p_name) > 8 THEN '...' || right(p_name, 5) ELSE p_name END AS short, CASE WHEN length(p_type) > 9 THEN left(p_type, 3) || '...' || right(p_type, 3) ELSE p_type END AS elided, nullif(regexp_extract('run_w' || p_size || '.json', 'w([0-9.]*[0-9])', 1), '')::DOUBLE AS swept FROM part""")
def name_functions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), T.shorten(F.col("p_name"), 8).alias("short"), T.elide(F.col("p_type"), 9).alias("elided"), T.swept_value(F.concat(F.lit("run_w"), F.col("p_size").cast("string"), F.lit(".json")), "w").alias("swept"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'held_' || p_brand ELSE 'all' END || '_w0.5' || CASE WHEN p_size % 2 = 0 THEN '_r' || p_size ELSE '' END || CASE WHEN p_size % 5 <> 0 THEN '_s' || (p_size % 5) ELSE '' END AS arm FROM part""")
def arm_names(spark, d):
    p = table(spark, d, "part")
    null = F.lit(None).cast("string")
    return p.select(F.col("p_partkey").alias("id"), T.arm_name(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.lit(0.5), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), null, F.col("p_size") % 5).alias("arm"))


@query("""SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN n_chars / 7.0::DOUBLE ELSE n_chars / 3.0::DOUBLE END, 6) AS score FROM documents""")
def logit_scores(spark, d):
    logits = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.0), F.col("n_chars") / 7.0)).otherwise(F.array(F.col("n_chars") / 3.0, F.lit(0.0), F.lit(1.0)))
    return table(spark, d, "documents").select("doc_id", T.logit_score(logits).alias("score"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, 0 AS priority FROM documents UNION ALL SELECT doc_id, 'label', quality, 1 FROM labels), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC) AS n FROM r) SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total FROM w WHERE n = 1 GROUP BY 1""")
def corpus_index(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.select("doc_id", "source", "n_chars", F.lit(0).alias("priority")).unionByName(labels.select("doc_id", F.lit("label").alias("source"), F.col("quality").cast("long").alias("n_chars"), F.lit(1).alias("priority")))
    return readers.by_priority(rows, "doc_id", "priority").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))


def _digest_sql(t: str, cols: list[str]) -> str:
    line = "concat_ws(chr(31), " + ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in cols) + ")"
    return f"SELECT '{t}' AS name, count(*) AS records, coalesce(sum(strlen({line})), 0)::BIGINT AS bytes, coalesce(sum(('0x' || left(sha256({line}), 12))::HUGEINT), 0)::VARCHAR AS digest FROM {t}"


_DIGESTED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"]}


@query(" UNION ALL ".join(_digest_sql(t, c) for t, c in _DIGESTED.items()))
def manifest_digests(spark, d):
    out = None
    for name, columns in _DIGESTED.items():
        one = readers.digest(table(spark, d, name), columns).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH o AS (SELECT n_nationkey AS ordinal, n_name AS name, n_regionkey AS records, 'old' AS digest FROM nation WHERE n_regionkey < 3), f AS (SELECT n_name AS name, count(c_custkey) AS records, md5(n_name) AS digest FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY n_name)
SELECT ordinal, name, coalesce(f.records, o.records) AS records, coalesce(f.digest, o.digest) AS digest FROM o LEFT JOIN f USING (name) UNION ALL SELECT (SELECT max(ordinal) FROM o) + row_number() OVER (ORDER BY name), name, records, digest FROM f WHERE name NOT IN (SELECT name FROM o)""")
def manifest_upsert(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    old = nation.filter("n_regionkey < 3").select(F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("records"), F.lit("old").alias("digest"))
    made = nation.filter("n_nationkey % 2 = 0").join(customer, nation["n_nationkey"] == customer["c_nationkey"], "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("records")).withColumn("digest", F.md5("name"))
    return readers.upsert_stage(old, made)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_ingest(spark, d):
    folder = f"{shared_folder(spark)}/lumiform/stream-{uuid.uuid4().hex}"
    return available_counts(spark, d, "events", f"{folder}/checkpoint", f"{folder}/out").withColumn("total", F.round("total", 4))


@query(r"""WITH b AS (SELECT html, regexp_matches(coalesce(html, ''), '(?i)<article\b') AS hit, length(regexp_extract_all(coalesce(html, ''), '(?i)<p\b[^>]*>')) AS ps FROM pages) SELECT count(*) AS scanned, count(*) FILTER (html IS NULL OR html = '') AS empty, count(*) FILTER (hit) AS matched, sum(ps)::BIGINT AS paragraphs FROM b""")
def scan_stats(spark, d):
    html = F.coalesce("html", F.lit(""))
    return table(spark, d, "pages").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(html == "").alias("empty"), F.count_if(F.regexp_like(html, F.lit(r"(?i)<article\b"))).alias("matched"),
        F.sum(F.size(F.regexp_extract_all(html, F.lit(r"(?i)<p\b[^>]*>"), F.lit(0)))).alias("paragraphs"),
    )


# -- scorers


_OV = REN + r""", o AS (SELECT id, format, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(rendered), '[\p{L}\p{N}_]+')) AS p FROM ren)"""


def _pairs(spark, d):
    return rendered(spark, d).select("id", "format", "question", F.col("rendered").alias("passage"))


@query(f"WITH {_OV} SELECT id, format, round(coalesce(len(list_intersect(q, p))::DOUBLE / nullif(len(q), 0), 0), 6) AS score FROM o")
def overlap_scores(spark, d):
    return scorers.OverlapScorer().score(_pairs(spark, d)).select("id", "format", "score")


@query(f"WITH {_OV} SELECT format, count(*) AS n, round(avg(coalesce(len(list_intersect(q, p))::DOUBLE / nullif(len(q), 0), 0)), 6) AS mean FROM o GROUP BY 1")
def batch_scorer(spark, d):
    return scorers.BatchScorer(scorers.overlap_model).score(_pairs(spark, d)).groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
