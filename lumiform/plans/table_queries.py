"""The catalogue's third part: tables of the training study, each resampled at the reference's sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiform.functions.render import FORMATS
from lumiform.operators import answer, axes, resample, seeds, study, training
from lumiform.plans.base import STUDY, grids, led, led_sql, tens, tensor_sql
from lumiform.plans.queries import _CI, N_BOOT, N_PERMUTATIONS, _chance, _keys, also, query
from lumiform.plans.study_queries import _ML, _POL, _policies
from lumiform.sources.readers import table
from lumiform.sources.scratch import kept

#: An arm trained on each format alone, for each model and seed.
SPECIALISTS = [(m, f"only_{f}", s, 24 + 2 * i + k, 1) for m, k in (("m1", 0), ("m2", 12)) for i, f in enumerate(FORMATS) for s in (0, 1)]

_OUT = f"""WITH {led_sql(STUDY + SPECIALISTS)},
ml AS (SELECT model, arm, seed, query_id, gf, product(share) AS pr FROM (SELECT n.model, n.arm, n.seed, n.query_id, n.cand, g.format AS gf, avg((n.score <= g.score)::INT) AS share FROM tensor n JOIN tensor g ON n.model = g.model AND n.arm = g.arm AND n.seed = g.seed AND n.query_id = g.query_id AND g.cand = 0 WHERE n.cand > 0 AND n.arm IN ('control', 'winner') AND g.arm IN ('control', 'winner') GROUP BY ALL) GROUP BY ALL),
o AS (SELECT model, CASE WHEN arm LIKE 'only%' THEN 'specialist' ELSE arm END AS condition, 'standardised' AS policy, seed, query_id, format, lead::INT::DOUBLE AS value FROM led WHERE arm NOT LIKE 'only%' OR arm = 'only_' || format
  UNION ALL SELECT model, arm, 'mixed', seed, query_id, format, avg(pr) AS value FROM ml CROSS JOIN fmt GROUP BY ALL)"""


def _outcomes(spark, d):
    """Outcomes of all arms; of a specialist only the scores under its own format are made, and of the mixed corpus only those of trained arms."""
    told = study.led_and_mixed(grids(spark, d, STUDY))
    special = kept(led(spark, d, SPECIALISTS, formats=lambda arm: (arm[1].removeprefix("only_"),)), "leads")
    both = answer.leads_in(told, "leads", study.TENSOR_KEYS).unionByName(special)
    return training.outcomes(both, told.filter("arm <> 'untrained'").select(*study.TENSOR_KEYS, "query_id", "p"))


def _diff_sql(treatment: tuple[str, str], reference: tuple[str, str], by: str = ", format") -> str:
    of = lambda s: f"avg(value) FILTER (condition = '{s[0]}' AND policy = '{s[1]}')"
    return f"SELECT model{by}, query_id, {of(treatment)} - {of(reference)} AS diff FROM o GROUP BY ALL HAVING diff IS NOT NULL"


def _paired_sql(src: str, keys: str, family: str = "", tag: str = "") -> str:
    """CTEs that end in pr{tag}: keys, n, diff, ci_lo, ci_hi, p, p_floor, holm_p, resolved of the contrasts in src (keys, query_id, diff). For up to resample.BLOCK queries a key."""
    part = f"PARTITION BY {family} " if family else ""
    order = ", ".join(k for k in keys.split(", ") if k != family)
    return f"""px{tag} AS (SELECT {keys}, diff, row_number() OVER (PARTITION BY {keys} ORDER BY query_id) - 1 AS idx, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
kb{tag} AS ({_keys('draw', 'b', N_BOOT)}), kg{tag} AS ({_keys('sign', 'g', N_PERMUTATIONS // 32)}),
rw{tag} AS (SELECT DISTINCT n, idx FROM px{tag}), dq{tag} AS (SELECT b, n, {_chance('idx')} FROM rw{tag} CROSS JOIN kb{tag}), dw{tag} AS (SELECT b, n, (y % n)::BIGINT AS idx, count(*) AS t FROM dq{tag} GROUP BY ALL),
rm{tag} AS (SELECT {keys}, b, sum(t * diff) / sum(t) AS x FROM dw{tag} JOIN px{tag} USING (n, idx) GROUP BY ALL), ci{tag} AS (SELECT {keys}, {_CI} FROM rm{tag} GROUP BY ALL),
ob{tag} AS (SELECT {keys}, count(*) AS n, avg(diff) AS diff FROM px{tag} GROUP BY ALL),
fq{tag} AS (SELECT g, {_chance('idx')}, idx FROM (SELECT DISTINCT idx FROM px{tag}) CROSS JOIN kg{tag}),
pm{tag} AS (SELECT {keys}, g * 32 + bit AS perm, round(abs(sum(CASE WHEN (y >> bit::UBIGINT) & 1 = 0 THEN diff ELSE -diff END) / any_value(n)), 9) AS m FROM fq{tag} JOIN px{tag} USING (idx) CROSS JOIN (SELECT range AS bit FROM range(32)) GROUP BY ALL),
pp{tag} AS (SELECT {keys}, (1 + count(*) FILTER (m >= abs(round(diff, 9)))) / (count(*) + 1.0::DOUBLE) AS p, 1 / (count(*) + 1.0::DOUBLE) AS p_floor FROM pm{tag} JOIN ob{tag} USING ({keys}) GROUP BY ALL),
hs{tag} AS (SELECT *, (count(*) OVER ({part.strip()}) - row_number() OVER ({part}ORDER BY p, {order}) + 1) * p AS step FROM pp{tag}),
pr{tag} AS (SELECT {keys}, n, round(diff, 6) AS diff, lo AS ci_lo, hi AS ci_hi, round(p, 6) AS p, round(p_floor, 6) AS p_floor, hp AS holm_p, hp < 0.05 AS resolved
  FROM (SELECT *, least(1.0::DOUBLE, max(step) OVER ({part}ORDER BY p, {order} ROWS UNBOUNDED PRECEDING)) AS hp FROM hs{tag}) JOIN ob{tag} USING ({keys}) JOIN ci{tag} USING ({keys}))"""


_POINTS = ", ".join(f"avg(value) FILTER (condition = '{c}' AND policy = '{p}') AS {p}_{c}" for c, p in (("untrained", "standardised"), ("specialist", "standardised"), ("control", "mixed"), ("winner", "mixed")))
_LEVELS = f"lv AS (SELECT model, avg(standardised_untrained) AS untrained, avg(standardised_specialist) AS specialist, avg(mixed_control) AS control, avg(mixed_winner) AS winner FROM (SELECT model, format, {_POINTS} FROM o GROUP BY ALL) GROUP BY 1)"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("untrained", "specialist", "control", "winner"))
_POINTS_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("standardised_untrained", "standardised_specialist", "mixed_control", "mixed_winner"))


@query(f"{_OUT}, pt AS (SELECT model, format, {_POINTS} FROM o GROUP BY ALL) SELECT model, format, {_POINTS_ROUNDED} FROM pt")
def comparison_points_table(spark, d):
    return training.comparison_points(_outcomes(spark, d))


@query(f"{_OUT}, {_LEVELS} SELECT model, {_ROUNDED} FROM lv")
def training_levels_table(spark, d):
    return training.training_levels(_outcomes(spark, d))


_SPECIAL = (training.SPECIALIST, training.STANDARDISED)
_BASE = (training.UNTRAINED, training.STANDARDISED)
_P = "n, diff, ci_lo, ci_hi, p, p_floor, round(holm_p, 6) AS holm_p, resolved"


@query(f"{_OUT}, src AS ({_diff_sql(_SPECIAL, _BASE)}), {_paired_sql('src', 'model, format', 'model')} SELECT model, format, {_P} FROM pr")
def format_contrast_table(spark, d):
    return training.format_contrasts(_outcomes(spark, d), _SPECIAL, _BASE, N_BOOT, N_PERMUTATIONS)


_LEVEL_SRC = f"src AS (SELECT model, 'specialist' AS condition, query_id, diff FROM ({_diff_sql(_SPECIAL, ('control', 'mixed'), '')}) UNION ALL SELECT model, 'winner', query_id, diff FROM ({_diff_sql(('winner', 'mixed'), ('control', 'mixed'), '')}))"


@query(f"{_OUT}, {_LEVEL_SRC}, {_paired_sql('src', 'model, condition', 'condition')} SELECT model, condition, {_P} FROM pr")
def training_level_contrast_table(spark, d):
    return training.training_level_contrasts(_outcomes(spark, d), N_BOOT, N_PERMUTATIONS)


def _gap_sql(reference: str, tag: str = "") -> str:
    special, mixed = "avg(value) FILTER (condition = 'specialist')", f"avg(value) FILTER (condition = '{reference}')"
    return f"""src{tag} AS ({_diff_sql(_SPECIAL, (reference, 'mixed'))}), {_paired_sql(f'src{tag}', 'model, format', 'model', tag)},
sc{tag} AS (SELECT model, format, seed, {special} - {mixed} AS change FROM o WHERE (condition = 'specialist' AND policy = 'standardised') OR (condition = '{reference}' AND policy = 'mixed') GROUP BY ALL),
sm{tag} AS (SELECT model, format, avg(change) AS mean, min(change) AS lo, max(change) AS hi FROM sc{tag} GROUP BY ALL),
gp{tag} AS (SELECT model, format, any_value(diff) AS diff, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi, any_value(holm_p) AS holm_p, any_value(resolved) AS resolved, count(*) FILTER (sign(round(change, 9)) = sign(round(mean, 9))) AS same_sign, any_value(lo) AS seed_lo, any_value(hi) AS seed_hi
  FROM pr{tag} JOIN sm{tag} USING (model, format) JOIN sc{tag} USING (model, format) GROUP BY ALL),
sg{tag} AS (SELECT model, count(*) FILTER (sign(round(c, 9)) = sign(round(m, 9))) AS agree FROM (SELECT model, c, avg(c) OVER (PARTITION BY model) AS m FROM (SELECT model, seed, avg(change) AS c FROM sc{tag} GROUP BY ALL)) GROUP BY 1)"""


@query(f"{_OUT}, {_gap_sql('control')} SELECT model, format, diff, ci_lo, ci_hi, round(holm_p, 6) AS holm_p, resolved, same_sign, round(seed_lo, 6) AS seed_lo, round(seed_hi, 6) AS seed_hi FROM gp")
def training_gap_table(spark, d):
    return training.training_gaps(_outcomes(spark, d), training.CONTROL, N_BOOT, N_PERMUTATIONS)


_VS = lambda r: f"v{r} AS (SELECT model, avg(x.diff) AS diff_vs_{r}, count(*) FILTER (resolved) AS resolved_vs_{r} FROM gp{r} JOIN (SELECT model, format, avg(diff) AS diff FROM src{r} GROUP BY ALL) x USING (model, format) GROUP BY 1)"


@query(f"{_OUT}, {_LEVELS}, {_gap_sql('control', 'control')}, {_gap_sql('winner', 'winner')}, {_VS('control')}, {_VS('winner')} SELECT model, {_ROUNDED}, round(diff_vs_control, 6) AS diff_vs_control, resolved_vs_control, a.agree AS seeds_vs_control, round(diff_vs_winner, 6) AS diff_vs_winner, resolved_vs_winner, b.agree AS seeds_vs_winner FROM lv JOIN vcontrol USING (model) JOIN vwinner USING (model) JOIN sgcontrol a USING (model) JOIN sgwinner b USING (model)")
def training_summary_table(spark, d):
    return training.training_summary(_outcomes(spark, d), N_BOOT, N_PERMUTATIONS)


# -- contrasts of the standardisation study

_PD = "model, n, diff, ci_lo, ci_hi, p, p_floor, round(holm_p, 6) AS holm_p, resolved"


@query(f"WITH {led_sql(STUDY)}, {_POL}, src AS (SELECT model, query_id, avg(mixed) FILTER (arm = 'winner') - avg(mixed) FILTER (arm = 'control') AS diff FROM pol GROUP BY ALL), {_paired_sql('src', 'model')} SELECT {_PD} FROM pr")
def contrast_table(spark, d):
    return study.paired(study.contrast(_policies(spark, d), "mixed", "winner", "control"), N_BOOT, N_PERMUTATIONS)


_ARMS = ("untrained", "control", "winner")
_SHARES = ", ".join(f"round(avg(part) FILTER (arm = '{a}'), 6) AS disagree_{a}" for a in _ARMS)


@query(f"""WITH {led_sql(STUDY)}, c AS (SELECT model, arm, query_id, avg(part) AS part FROM (SELECT model, arm, seed, query_id, (count(*) FILTER (lead) BETWEEN 1 AND count(*) - 1)::INT::DOUBLE AS part FROM led GROUP BY ALL) GROUP BY ALL),
src AS (SELECT model, query_id, max(part) FILTER (arm = 'winner') - max(part) FILTER (arm = 'control') AS diff FROM c GROUP BY ALL), {_paired_sql('src', 'model')}, sh AS (SELECT model, {_SHARES} FROM c GROUP BY 1) SELECT disagree_untrained, disagree_control, disagree_winner, {_PD} FROM sh JOIN pr USING (model)""")
def agreement_table(spark, d):
    c = kept(answer.counts_of_leads(led(spark, d, STUDY), study.TENSOR_KEYS), "lead-counts")
    c = c.withColumn("some", ((F.col("k") > 0) & (F.col("k") < F.col("n"))).cast("double"))
    shares = c.groupBy("model", "arm", "query_id").agg(F.avg("some").alias("some")).groupBy("model").pivot("arm", list(_ARMS)).agg(F.avg("some"))
    shares = shares.select("model", *[F.col(a).alias(f"disagree_{a}") for a in _ARMS])
    return shares.join(study.paired(study.contrast(c, "some", "winner", "control"), N_BOOT, N_PERMUTATIONS), "model")


@query(f"""WITH {led_sql(STUDY)}, {_ML}, m AS (SELECT model, arm, format, avg(rr) AS mrr FROM led WHERE seed = 0 GROUP BY ALL), u AS (SELECT model, arm, max(mrr) AS best, avg(mrr) AS mean FROM m GROUP BY ALL), x AS (SELECT model, arm, avg(p) AS mixed FROM mx WHERE seed = 0 GROUP BY ALL)
SELECT model, arm, round(best, 6) AS uniform_best_mrr, round(mean, 6) AS uniform_mean_mrr, round(mixed, 6) AS mixed_top1, round(mixed - best, 6) AS delta, {-resample.NI_MARGIN}::DOUBLE AS ni_margin, mixed - best > {resample.NI_MARGIN} AS kept FROM u JOIN x USING (model, arm)""")
def guardrail_table(spark, d):
    """Of the first training seed, as in the reference."""
    t = tens(spark, d, STUDY).filter("seed = 0")
    m = answer.mrr(answer.leads(t, study.TENSOR_KEYS), ("model", "arm")).groupBy("model", "arm").agg(F.max("mrr").alias("uniform_best_mrr"), F.avg("mrr").alias("uniform_mean_mrr"))
    out = m.join(study.mixed_lead(t).groupBy("model", "arm").agg(F.avg("p").alias("mixed_top1")), ["model", "arm"]).withColumn("delta", F.col("mixed_top1") - F.col("uniform_best_mrr"))
    return out.withColumns({"ni_margin": F.lit(-resample.NI_MARGIN), "kept": F.col("delta") > resample.NI_MARGIN})


for _name in ("contrast_table", "agreement_table", "guardrail_table"):
    also(f"{_name}_full", _name)


# -- both axes from one state

_BASES = [("m1", "untrained", 0, 60, 4), ("m2", "untrained", 0, 72, 4)]
#: The scores of the queries that are scored again, and of the control's.
_AGAIN = [("m1", "untrained", 9, 61, 4), ("m2", "untrained", 9, 73, 4)]
_PAIR_NAMES = [f"{x}-{y}" for i, x in enumerate(FORMATS) for y in FORMATS[i + 1 :]]
_COLUMNS = ", ".join(f"max(g) FILTER (pair = '{p}') AS c{i}" for i, p in enumerate(_PAIR_NAMES))
_MOMENTS = ", ".join(f"sum(t * c{i}) / sum(t) AS m{i}, sum(t * c{i} * c{i}) / sum(t) AS q{i}" for i in range(len(_PAIR_NAMES)))
_LARGEST = "greatest(" + ", ".join(f"abs(m{i}) / (sqrt(greatest(q{i} - m{i} * m{i}, 0)) + 1e-12)" for i in range(len(_PAIR_NAMES))) + ")"


def _axes_sql(tensor: str, tag: str) -> str:
    """CTEs that end in st{tag}: model, b (-1: the sample itself), d, i of a tensor (model, query_id, cand, format, fpos, score). For up to resample.BLOCK queries."""
    return f"""gd{tag} AS (SELECT model, query_id, format, score AS g FROM {tensor} WHERE cand = 0),
ld{tag} AS (SELECT model, query_id, count(*) FILTER (above = 0) AS k FROM (SELECT t.model, t.query_id, t.format, count(*) FILTER (t.cand > 0 AND t.score > g) AS above FROM {tensor} t JOIN gd{tag} USING (model, query_id, format) GROUP BY ALL) GROUP BY ALL),
pd{tag} AS (SELECT model, query_id, {_COLUMNS} FROM (SELECT a.model, a.query_id, a.format || '-' || b.format AS pair, a.score - b.score AS g FROM {tensor} a JOIN {tensor} b ON a.cand = 0 AND b.cand = 0 AND a.model = b.model AND a.query_id = b.query_id AND a.fpos < b.fpos) GROUP BY ALL),
vl{tag} AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY query_id) - 1 AS idx FROM pd{tag} JOIN ld{tag} USING (model, query_id)),
ws{tag} AS (SELECT b, idx, t FROM dw UNION ALL SELECT -1, idx, 1 FROM (SELECT DISTINCT idx FROM vl{tag})),
mo{tag} AS (SELECT model, b, {_MOMENTS}, sum(t) FILTER (k > 0) AS a, sum(t) FILTER (k > 0 AND k < 5) AS x FROM ws{tag} JOIN vl{tag} USING (idx) GROUP BY ALL),
st{tag} AS (SELECT model, b, {_LARGEST} AS d, coalesce(x, 0) * 100.0::DOUBLE / nullif(a, 0) AS i FROM mo{tag})"""


_DW = f"nq AS (SELECT count(*) AS n FROM documents), iq AS (SELECT range AS idx, n FROM nq, range(4096) WHERE range < n), kb AS ({_keys('draw', 'b', N_BOOT)}), dq AS (SELECT b, n, {_chance('idx')} FROM iq CROSS JOIN kb), dw AS (SELECT b, (y % n)::BIGINT AS idx, count(*) AS t FROM dq GROUP BY ALL)"
_TWO_TENSORS = f"""WITH {tensor_sql(_BASES + _AGAIN)}, old AS (SELECT model, query_id, cand, format, fpos, score FROM tensor WHERE seed = 0), again AS (SELECT model, query_id, cand, format, fpos, score FROM tensor WHERE seed = 9),
new AS (SELECT * FROM old WHERE query_id % 10 <> 0 UNION ALL SELECT * FROM again WHERE query_id % 10 = 0), {_DW}"""


def _ends(c: str, name: str) -> str:
    return f"round(quantile_cont({c}, 0.025) FILTER (b >= 0), 6) AS {name}_lo, round(quantile_cont({c}, 0.975) FILTER (b >= 0), 6) AS {name}_hi"


@query(f"""{_TWO_TENSORS}, {_axes_sql('old', '0')}, {_axes_sql('new', '1')}, ct AS (SELECT model, max(abs(a.score - o.score)) AS diff FROM again a JOIN old o USING (model, query_id, cand, format) WHERE query_id % 25 = 1 GROUP BY 1),
bf AS (SELECT model, max(d) FILTER (b = -1) AS d, max(i) FILTER (b = -1) AS i FROM st0 GROUP BY 1), af AS (SELECT model, round(max(d) FILTER (b = -1), 6) AS max_abs_d_rescored, {_ends('d', 'd')}, round(max(i) FILTER (b = -1), 6) AS inconsistency_pct_rescored, {_ends('i', 'inconsistency')} FROM st1 GROUP BY 1)
SELECT model, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS rescored, round(bf.d, 6) AS max_abs_d, round(bf.i, 6) AS inconsistency_pct, max_abs_d_rescored, d_lo, d_hi, inconsistency_pct_rescored, inconsistency_lo, inconsistency_hi, round(diff, 6) AS control_max_abs_diff FROM bf JOIN af USING (model) JOIN ct USING (model)""")
def rescored_table(spark, d):
    again = tens(spark, d, _AGAIN)
    return axes.rescored_table(tens(spark, d, _BASES), again.filter("query_id % 10 = 0"), again.filter("query_id % 25 = 1"), N_BOOT)


@query(f"""WITH {tensor_sql(_BASES)}, {_DW}, {_axes_sql('tensor', '0')}, pv AS (SELECT model, max(d) FILTER (b = -1) AS d, (1 + count(*) FILTER (b >= 0 AND d <= 0.5)) / (count(*) FILTER (b >= 0) + 1.0::DOUBLE) AS p1, max(i) FILTER (b = -1) AS i, (1 + count(*) FILTER (b >= 0 AND i <= 0)) / (count(*) FILTER (b >= 0 AND i IS NOT NULL) + 1.0::DOUBLE) AS p2 FROM st0 GROUP BY 1),
s1 AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p1, model) + 1) * p1 AS t1, (count(*) OVER () - row_number() OVER (ORDER BY p2, model) + 1) * p2 AS t2 FROM pv), s2 AS (SELECT *, least(1.0::DOUBLE, max(t1) OVER (ORDER BY p1, model ROWS UNBOUNDED PRECEDING)) AS h1, least(1.0::DOUBLE, max(t2) OVER (ORDER BY p2, model ROWS UNBOUNDED PRECEDING)) AS h2 FROM s1)
SELECT model, round(d, 6) AS max_abs_d, round(p1, 6) AS p_above_threshold, round(i, 6) AS inconsistency_pct, round(p2, 6) AS p_above_zero, round(h1, 6) AS holm_threshold, h1 < 0.05 AS above_threshold, round(h2, 6) AS holm_zero, h2 < 0.05 AS inconsistent FROM s2""")
def family_table(spark, d):
    t = tens(spark, d, _BASES)
    return axes.family_table(axes.statistics(axes.state_of(axes.rows_of(t, axes.indexed(t)), N_BOOT)), N_BOOT)


# -- seeds

_KEYS = "model, arm, seed"
_LEVEL = f"""WITH {led_sql(STUDY)}, pd AS (SELECT a.model, a.arm, a.seed, a.format || '-' || b.format AS pair, avg(a.score - b.score) / (stddev_pop(a.score - b.score) + 1e-12) AS d FROM tensor a JOIN tensor b ON a.cand = 0 AND b.cand = 0 AND a.model = b.model AND a.arm = b.arm AND a.seed = b.seed AND a.query_id = b.query_id AND a.fpos < b.fpos GROUP BY ALL),
ds AS (SELECT {_KEYS}, max(abs(d)) AS score FROM pd GROUP BY ALL), kq AS (SELECT {_KEYS}, query_id, count(*) FILTER (lead) AS k, count(*) AS n FROM led GROUP BY ALL), an AS (SELECT {_KEYS}, count(*) FILTER (k > 0 AND k < n) * 100.0::DOUBLE / nullif(count(*) FILTER (k > 0), 0) AS answer FROM kq GROUP BY ALL),
mr AS (SELECT {_KEYS}, avg(m) AS mrr FROM (SELECT {_KEYS}, format, avg(rr) AS m FROM led GROUP BY ALL) GROUP BY ALL), lv AS (SELECT * FROM ds JOIN an USING ({_KEYS}) JOIN mr USING ({_KEYS})),
sl AS (SELECT model, seed, {', '.join(f"max({c}) FILTER (arm = '{a}') AS {c}_{n}" for c in seeds.STATISTICS for a, n in (('control', 'control'), ('winner', 'chosen')))} FROM lv WHERE arm IN ('control', 'winner') GROUP BY ALL)"""


def _levels(spark, d):
    return seeds.seed_levels(seeds.levels_of(tens(spark, d, STUDY)), "control", "winner")


@query(f"""{_LEVEL} SELECT model, seed, {', '.join(f'round({c}_{n}, 6) AS {c}_{n}' for c in seeds.STATISTICS for n in ('control', 'chosen'))}, {', '.join(f'round({c}_chosen - {c}_control, 6) AS {c}_delta, round(100 * ({c}_chosen - {c}_control) / nullif({c}_control, 0), 6) AS {c}_pct' for c in ('score', 'answer'))} FROM sl""")
def seed_levels(spark, d):
    return _levels(spark, d)


def _model_pairs(spark):
    return spark.createDataFrame([("m1", "m2")], "base string, variant string")


_SEED_PAIRS = "sp AS (SELECT b.model AS base, seed, b.score_chosen AS x, v.score_chosen AS y FROM sl b JOIN sl v USING (seed) WHERE b.model = 'm1' AND v.model = 'm2')"


@query(f"{_LEVEL}, {_SEED_PAIRS} SELECT base, seed, round(x, 6) AS base_value, round(y, 6) AS variant_value, round(y - x, 6) AS difference FROM sp")
def seed_pairs(spark, d):
    return seeds.seed_pairs(_levels(spark, d), "score_chosen", _model_pairs(spark))


@query(f"""{_LEVEL}, {_SEED_PAIRS}, a AS (SELECT base, avg(x) AS bm, stddev_samp(x) AS bs, avg(y) AS vm, stddev_samp(y) AS vs, count(*) FILTER (y < x) AS lower, count(*) FILTER (y <> x) AS untied FROM sp GROUP BY 1), w AS (SELECT base, sum(factorial(untied::INT)::DOUBLE / (factorial(k::INT)::DOUBLE * factorial((untied - k)::INT)::DOUBLE)) AS ways FROM a, range(21) r(k) WHERE k <= least(lower, untied - lower) GROUP BY 1)
SELECT base, round(bm, 6) AS base_mean, round(bs, 6) AS base_sd, round(vm, 6) AS variant_mean, round(vs, 6) AS variant_sd, lower AS variant_lower, untied, CASE WHEN untied > 0 THEN round(least(1.0::DOUBLE, 2 * ways / pow(2, untied)), 6) END AS sign_p FROM a JOIN w USING (base)""")
def paired_table(spark, d):
    return seeds.paired_table(seeds.seed_pairs(_levels(spark, d), "score_chosen", _model_pairs(spark)))


@query(f"{_LEVEL} SELECT model, round(max(score_chosen - score_control) FILTER (seed = 0), 6) AS seed_0, round(max(score_chosen - score_control) FILTER (seed = 1), 6) AS seed_1 FROM sl GROUP BY 1")
def seed_fold_matrix(spark, d):
    return seeds.seed_matrix(_levels(spark, d), "score_delta", [0, 1])


# -- sweeps of several models

_SWEEPS = """WITH r AS (SELECT l_returnflag AS model, round(l_discount, 2) AS value, round(avg(l_extendedprice) / 40000, 9) AS d, round(-avg(l_tax), 9) AS m FROM lineitem GROUP BY ALL), c AS (SELECT model, value, d, d - 0.01 AS d_lo, d + 0.01 AS d_hi, m + 0.0102 AS mrr_lo, m + 0.03 AS mrr_hi, m + 0.0102 > -0.03 AS survives FROM r),
l AS (SELECT * FROM c WHERE survives QUALIFY row_number() OVER (PARTITION BY model ORDER BY d, value) = 1),
t AS (SELECT c.*, coalesce(c.survives AND c.d_lo <= l.d_hi AND l.d_lo <= c.d_hi AND c.mrr_lo <= l.mrr_hi AND l.mrr_lo <= c.mrr_hi, false) AS tied FROM c LEFT JOIN l USING (model)),
w AS (SELECT *, tied AND row_number() OVER (PARTITION BY model, tied ORDER BY value) = floor(((count(*) FILTER (tied) OVER (PARTITION BY model)) + 1) / 2) AS winner FROM t)"""


def _selected(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.round("l_discount", 2).alias("value")).agg(F.round(F.avg("l_extendedprice") / 40000, 9).alias("d"), F.round(-F.avg("l_tax"), 9).alias("m"))
    rows = r.select("model", "value", "d", (F.col("d") - 0.01).alias("d_lo"), (F.col("d") + 0.01).alias("d_hi"), (F.col("m") + 0.0102).alias("mrr_lo"), (F.col("m") + 0.03).alias("mrr_hi"))
    return resample.select_winner(rows, keys=("model",))


@query(f"{_SWEEPS} SELECT model, round(value, 6) AS weight, round(d, 6) AS max_abs_d, round(d_lo, 6) AS ci_lo, round(d_hi, 6) AS ci_hi, tied, winner FROM w")
def weight_frame(spark, d):
    return resample.weight_frame(_selected(spark, d), ("model",))


@query(f"{_SWEEPS}, k AS (SELECT model, count(*) FILTER (survives) AS p, count(*) AS c, count(*) FILTER (tied) > 1 AS t FROM w GROUP BY 1) SELECT sum(p)::BIGINT AS passed, sum(c)::BIGINT AS candidates, count(*) FILTER (t) AS tie_broken FROM k")
def selection_counts(spark, d):
    return resample.selection_counts(_selected(spark, d), ("model",))
