"""The catalogue's fourth part: vectors and scores from text, and the geometry of the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiform.functions import render
from lumiform.operators import effect, encode, geometry
from lumiform.operators.encode import Arm
from lumiform.plans.base import HELD, REN, h, recs
from lumiform.plans.queries import query
from lumiform.sources.scratch import kept, spread

UNTRAINED = [Arm("m1", "untrained", 0, 1.0), Arm("m2", "untrained", 0, 1.3)]
TRAINED = [Arm(m, a, s, markup - 0.04 * s) for m, k in (("m1", 0.0), ("m2", 0.15)) for a, markup in (("control", 0.8 + k), ("winner", 0.35 + k)) for s in (0, 1)]
ARMS = UNTRAINED + TRAINED
ON = ["model", "arm", "seed"]


def enc_sql(arms: list[Arm], kind: str = "ft") -> str:
    """CTEs that end in ft: model, arm, seed, record_id, format, fpos, dim, x; and sc: the scores."""
    values = ", ".join(f"('{a.model}', '{a.arm}', {a.seed}, {a.markup}::DOUBLE)" for a in arms)
    token = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"
    w = encode.WIDTH
    hashes = lambda src: f"(SELECT t, model, ('0x' || substr(md5(model || '|' || t), 1, 8))::BIGINT AS hh, regexp_matches(t, '^[\\p{{L}}\\p{{N}}_]') AS word FROM (SELECT DISTINCT t FROM {src}) CROSS JOIN (SELECT DISTINCT model FROM am))"
    sign = f"(1 - 2 * (hh // {w} % 2))"
    return f"""{REN}, am AS (SELECT * FROM (VALUES {values}) a(model, arm, seed, markup)),
tf AS (SELECT id, format, fpos, t, 1 + ln(count(*)) AS w FROM (SELECT id, format, fpos, unnest(regexp_extract_all(lower(rendered), '{token}')) AS t FROM ren) GROUP BY ALL),
sm AS (SELECT model, id, format, fpos, hh % {w} AS dim, coalesce(sum(w * {sign}) FILTER (word), 0) AS words, coalesce(sum(w * {sign}) FILTER (NOT word), 0) AS marks FROM tf JOIN {hashes('tf')} USING (t) GROUP BY ALL),
v0 AS (SELECT model, arm, seed, id, format, fpos, dim, words + markup * marks AS x FROM sm JOIN am USING (model)),
nm AS (SELECT model, arm, seed, id, format, fpos, sqrt(sum(x * x)) AS norm FROM v0 GROUP BY ALL),
ft AS (SELECT nm.model, nm.arm, nm.seed, nm.id AS record_id, nm.format, nm.fpos, g.dim, coalesce(x / nullif(norm, 0), 0) AS x FROM nm CROSS JOIN (SELECT range AS dim FROM range({w})) g LEFT JOIN v0 ON v0.model = nm.model AND v0.arm = nm.arm AND v0.seed = nm.seed AND v0.id = nm.id AND v0.format = nm.format AND v0.dim = g.dim),
qf AS (SELECT id, t, 1 + ln(count(*)) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM rec) GROUP BY ALL),
q0 AS (SELECT model, id, hh % {w} AS dim, sum(w * {sign}) AS y FROM qf JOIN {hashes('qf')} USING (t) GROUP BY ALL), qn AS (SELECT model, id, sqrt(sum(y * y)) AS qnorm FROM q0 GROUP BY ALL),
sc AS (SELECT ft.model, ft.arm, ft.seed, record_id, format, fpos, sum(x * coalesce(y / nullif(qnorm, 0), 0)) AS score FROM ft LEFT JOIN q0 ON q0.model = ft.model AND q0.id = record_id AND q0.dim = ft.dim LEFT JOIN qn ON qn.model = ft.model AND qn.id = record_id GROUP BY ALL)"""


def _texts(spark, d):
    """record_id, question, heads, body, dealt to tasks by their number."""
    return spread(recs(spark, d).select(F.col("id").alias("record_id"), "question", "pairs", "body"), "record_id").select("record_id", "question", render.heads().alias("heads"), "body")


def by_record(spark, d, arms=ARMS):
    """model, arm, seed, record_id, all (format, fpos, vec, score): a row a record and arm."""
    return encode.by_record(_texts(spark, d), arms)


def encoded(spark, d, arms=ARMS):
    """model, arm, seed, record_id, format, fpos, vec, score of every record's five renderings."""
    return by_record(spark, d, arms).select(*ON, "record_id", F.explode("all").alias("r")).select(*ON, "record_id", "r.*")


@query(f"WITH {enc_sql(ARMS)}, dg AS (SELECT model, arm, seed, record_id, format, sum(x * (dim + 1)) AS digest FROM ft GROUP BY ALL) SELECT model, arm, seed, record_id, format, round(score, 6) AS score, round(digest, 6) AS digest FROM sc JOIN dg USING (model, arm, seed, record_id, format)")
def features_and_scores(spark, d):
    digest = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return encoded(spark, d).select(*ON, "record_id", "format", "score", digest.alias("digest"))


ONE = UNTRAINED[:1]


def _feats(spark, d):
    return encoded(spark, d, ONE).select("record_id", "format", "fpos", "vec")


_PAIRED = """df AS (SELECT a.model, a.arm, a.seed, a.record_id, a.format AS "left", b.format AS "right", a.format || '-' || b.format AS pair, a.dim, a.x - b.x AS x FROM ft a JOIN ft b ON a.model = b.model AND a.arm = b.arm AND a.seed = b.seed AND a.record_id = b.record_id AND a.dim = b.dim AND a.fpos < b.fpos),
sp AS (SELECT model, arm, seed, "left", "right", pair, sqrt(sum(m * m)) / nullif(sqrt(sum(v)), 0) AS separation FROM (SELECT model, arm, seed, "left", "right", pair, dim, avg(x) AS m, var_pop(x) AS v FROM df GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {enc_sql(ONE)}, {_PAIRED} SELECT pair, round(separation, 6) AS separation FROM sp")
def pair_separation(spark, d):
    return _separations(spark, d, ONE).select("pair", "separation")


@query(f"WITH {enc_sql(ONE)}, s AS (SELECT format, dim, avg(x) AS m, var_pop(x) AS v FROM ft GROUP BY ALL), z AS (SELECT dim, var_pop(m) AS b, avg(v) AS w FROM s GROUP BY 1) SELECT round(sum(b) / (sum(b) + sum(w)), 6) AS separation FROM z")
def spread_share(spark, d):
    return geometry.spread_share(_feats(spark, d))


@query(f"WITH {enc_sql(ONE)}, m AS (SELECT record_id, dim, avg(x) AS m FROM ft GROUP BY ALL) SELECT format, round(avg(n), 6) AS mean_norm FROM (SELECT format, record_id, sqrt(sum((x - m) ** 2)) AS n FROM ft JOIN m USING (record_id, dim) GROUP BY ALL) GROUP BY 1")
def format_shift_norms(spark, d):
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return geometry.shifts_in(by_record(spark, d, ONE)).groupBy("format").agg(F.avg(norm).alias("mean_norm"))


@query(f"WITH {enc_sql(ONE)}, a AS (SELECT *, {h(chr(39) + '0' + chr(39), chr(39) + 'half' + chr(39), 'record_id')} % 2 AS half FROM ft) SELECT half, format, count(DISTINCT record_id) AS n, round(avg(x), 6) AS mean FROM a GROUP BY ALL")
def halves(spark, d):
    rows = _feats(spark, d).select(geometry.half_of().alias("half"), "format", "record_id", F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x).alias("sum"), F.size("vec").alias("dims"))
    return rows.groupBy("half", "format").agg(F.count_distinct("record_id").alias("n"), (F.sum("sum") / F.sum("dims")).alias("mean"))


@query(f"""WITH {enc_sql(ONE)}, od AS (SELECT id, row_number() OVER (ORDER BY {h(chr(39) + '0' + chr(39), chr(39) + 'content' + chr(39), 'id')}, id) - 1 AS idx, count(*) OVER () AS n FROM rec),
pr AS (SELECT a.id AS left_id, b.id AS right_id, a.idx // 2 AS pair FROM od a JOIN od b ON a.idx % 2 = 0 AND b.idx = a.idx + 1)
SELECT pair, left_id, right_id, a.format, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS length FROM pr JOIN ft a ON a.record_id = left_id JOIN ft b ON b.record_id = right_id AND a.format = b.format AND a.dim = b.dim GROUP BY ALL""")
def content_differences(spark, d):
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    return geometry.content_differences(_feats(spark, d)).select("pair", "left_id", "right_id", "format", length.alias("length"))


_RATIO = f"""rt AS (SELECT model, seed, CASE WHEN "left" = '{HELD}' OR "right" = '{HELD}' THEN 'held_out' ELSE 'training' END AS pairs, avg(separation) FILTER (arm = 'winner') / avg(separation) FILTER (arm = 'control') AS ratio FROM sp WHERE arm IN ('winner', 'control') GROUP BY ALL)"""


def _separations(spark, d, arms):
    return geometry.separations_of(geometry.pair_moments(by_record(spark, d, arms)))


@query(f"WITH {enc_sql(TRAINED)}, {_PAIRED}, {_RATIO}, w AS (SELECT model, avg(ratio) FILTER (pairs = 'training') AS tm, coalesce(stddev_samp(ratio) FILTER (pairs = 'training'), 0) AS ts, avg(ratio) FILTER (pairs = 'held_out') AS hm, coalesce(stddev_samp(ratio) FILTER (pairs = 'held_out'), 0) AS hs FROM rt GROUP BY 1) SELECT model, round(tm, 6) AS training_mean, round(ts, 6) AS training_sd, round(hm, 6) AS held_out_mean, round(hs, 6) AS held_out_sd, round(hm - tm, 6) AS difference FROM w")
def ratio_frame(spark, d):
    return geometry.ratio_frame(geometry.ratios(_separations(spark, d, TRAINED), HELD, "winner", "control"))


_MAXD = """ed AS (SELECT a.model, a.arm, a.seed, a.format || '-' || b.format AS pair, avg(a.score - b.score) / (stddev_pop(a.score - b.score) + 1e-12) AS d FROM sc a JOIN sc b ON a.model = b.model AND a.arm = b.arm AND a.seed = b.seed AND a.record_id = b.record_id AND a.fpos < b.fpos GROUP BY ALL)"""
_MIT = f"""{_PAIRED}, {_RATIO}, {_MAXD}, md AS (SELECT model, seed, max(abs(d)) FILTER (arm = 'winner') - max(abs(d)) FILTER (arm = 'control') AS score_delta FROM ed GROUP BY ALL),
mt AS (SELECT model, seed, score_delta, 100 * (ratio - 1) AS separation_change FROM rt JOIN md USING (model, seed) WHERE pairs = 'training')"""


def _mitigation(spark, d):
    told = geometry.pair_moments(by_record(spark, d, TRAINED))
    effects, separations = geometry.effects_of(told), geometry.separations_of(told)
    return geometry.mitigation_frame(geometry.ratios(separations, HELD, "winner", "control"), effect.max_abs_d(effects, tuple(ON)), "winner", "control")


@query(f"WITH {enc_sql(TRAINED)}, {_MIT} SELECT model, seed, round(score_delta, 6) AS score_delta, round(separation_change, 6) AS separation_change FROM mt")
def mitigation_frame(spark, d):
    return _mitigation(spark, d)


@query(f"WITH {enc_sql(TRAINED)}, {_MIT} SELECT coalesce(model, 'pooled') AS model, count(*) AS n, round(avg(score_delta), 6) AS score_delta, round(avg(separation_change), 6) AS separation_change, round(corr(score_delta, separation_change), 6) AS r FROM mt GROUP BY GROUPING SETS ((model), ())")
def mitigation_summary(spark, d):
    return geometry.mitigation_summary(_mitigation(spark, d))


_PF = f"{_PAIRED}, {_MAXD}, pf AS (SELECT model, pair, separation, abs(d) AS h1_abs_d FROM sp JOIN ed USING (model, arm, seed, pair))"


def _pair_frame(spark, d):
    told = geometry.pair_moments(by_record(spark, d, UNTRAINED))
    effects = geometry.effects_of(told).select("model", "pair", F.abs("d").alias("h1_abs_d"))
    return geometry.separations_of(told).select("model", "pair", "separation").join(effects, ["model", "pair"])


@query(f"WITH {enc_sql(UNTRAINED)}, {_PF} SELECT model, pair, round(separation, 6) AS separation, round(h1_abs_d, 6) AS h1_abs_d FROM pf")
def pair_frame(spark, d):
    return _pair_frame(spark, d)


_RANKED = "rank() OVER (PARTITION BY model ORDER BY {0}) + (count(*) OVER (PARTITION BY model, {0}) - 1) / 2.0::DOUBLE"


@query(f"WITH {enc_sql(UNTRAINED)}, {_PF}, g AS (SELECT model, round(separation, 9) AS x, round(h1_abs_d, 9) AS y FROM pf UNION ALL SELECT 'pooled', round(separation, 9), round(h1_abs_d, 9) FROM pf), k AS (SELECT model, {_RANKED.format('x')} AS a, {_RANKED.format('y')} AS b FROM g) SELECT model, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY 1")
def rank_frame(spark, d):
    return geometry.rank_frame(kept(_pair_frame(spark, d), "pair-frame"))


@query()
def whitened_separation(spark, d):
    moments = geometry.grid_moments_of(_texts(spark, d), UNTRAINED, [0])
    return geometry.solved_grid(moments, [(geometry.SHRINKAGE, 0)], "of").select(F.split("of", "\\|")[0].alias("model"), "shrinkage", "split", "pair", "separation")


@query()
def range_table(spark, d):
    """Every setting's summary. Arms are models of the grid, so one pass makes the moments of all arms and settings."""
    effects = geometry.effects_of(geometry.pair_moments(by_record(spark, d, UNTRAINED))).select("model", "pair", F.abs("d").alias("h1_abs_d"))
    grid = kept(geometry.solved_grid(geometry.grid_moments_of(_texts(spark, d), ARMS, sorted({s for _, s in geometry.SETTINGS})), geometry.SETTINGS, "of"), "grid")
    part = F.split("of", "\\|")
    grid = grid.select("shrinkage", "split", part[0].alias("model"), part[1].alias("arm"), part[2].cast("int").alias("seed"), "pair", F.split("pair", "-")[0].alias("left"), F.split("pair", "-")[1].alias("right"), "separation")
    base = grid.filter("arm = 'untrained'").select("shrinkage", "split", "model", "pair", "separation")
    keyed = base.join(effects, ["model", "pair"]).withColumn("model", F.concat_ws("|", "shrinkage", "split"))
    rhos = geometry.rank_frame(keyed).filter("model <> 'pooled'").select(F.split("model", "\\|")[0].cast("double").alias("shrinkage"), F.split("model", "\\|")[1].cast("int").alias("split"), F.col("rho").alias("pooled_rho"))
    return geometry.range_table(base, rhos, geometry.ratios(grid, HELD, "winner", "control", ("shrinkage", "split")), "m1").withColumn("shrinkage", F.format_string("%g", "shrinkage"))


def _planes(spark, d):
    shifts = kept(geometry.shifts_in(by_record(spark, d, ONE)), "shifts")
    return shifts.filter(geometry.half_of() == 0), shifts.filter(geometry.half_of() == 1)


@query()
def plane_view(spark, d):
    fit, show = _planes(spark, d)
    return geometry.spread_share(geometry.projected(show, geometry.mean_plane_of(fit)))


@query()
def discriminant_plane(spark, d):
    fit, show = _planes(spark, d)
    return geometry.spread_share(geometry.projected(show, geometry.discriminant_plane_of(fit)))
