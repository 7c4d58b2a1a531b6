"""The catalogue's fifth part: order and fit of what is measured, scoring that goes on, and watched jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumiform.functions import budget as B
from lumiform.functions.render import FORMATS, explode_formats
from lumiform.operators import order, scorers
from lumiform.plans import scoring
from lumiform.plans.base import FMT, REN, gold_scores, recs, ren_sql, rendered, tensor_sql
from lumiform.plans.queries import _BUDGET, _count, query
from lumiform.sources import results
from lumiform.sources.readers import table
from lumiform.sources.scratch import shared_folder
from lumiform.streaming import watch

# -- order and fit

#: Positions that trade places in the recorded order.
SWAPPED = (7, 8)


@query(f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), b AS (SELECT id, CASE pos WHEN {SWAPPED[0]} THEN {SWAPPED[1]} WHEN {SWAPPED[1]} THEN {SWAPPED[0]} ELSE pos END AS pos FROM a),
f AS (SELECT min(a.pos) AS pos FROM a JOIN b USING (pos) WHERE a.id <> b.id) SELECT (SELECT count(*) FROM a) AS found_n, (SELECT count(*) FROM b) AS recorded_n, f.pos IS NULL AS same, f.pos, a.id AS found_id, b.id AS recorded_id FROM f LEFT JOIN a USING (pos) LEFT JOIN b USING (pos)""")
def check_order(spark, d):
    from lumiform.functions.ranking import dense_index

    found = dense_index(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "pos")
    swapped = F.when(F.col("pos") == SWAPPED[0], SWAPPED[1]).when(F.col("pos") == SWAPPED[1], SWAPPED[0]).otherwise(F.col("pos"))
    return order.check_order(found, found.select("id", swapped.cast("long").alias("pos")))


_DIGEST = "('0x' || substr(md5(concat_ws('|', 'order', pos, id)), 1, 8))::HUGEINT"


@query(f"WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT pos // 1024 AS part, count(*) AS n, (sum({_DIGEST}) % {order.PRIME})::BIGINT AS digest FROM a GROUP BY 1")
def order_digests(spark, d):
    from lumiform.functions.ranking import dense_index

    return order.digests(dense_index(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "pos"), 10)


def _cut_sql(name: str, piece: str, tokens: str) -> str:
    """CTEs that end in cut_{name}: id, t, the body within budget tokens of one tokenizer."""
    return f"""p_{name} AS (SELECT id, body, b_{name} AS b, array_to_string(list_slice(regexp_extract_all(body, '\\s*{piece}'), 1, greatest(b_{name}, 1)), '') AS c FROM bud),
q_{name} AS (SELECT *, greatest(length(c) - 500, 0) AS st FROM p_{name}), r_{name} AS (SELECT *, regexp_extract(substr(c, st + 1), '(?s)^(.*[.!?])(?:[ \\t\\n].*)?$', 1) AS sen, length(c) - strpos(reverse(c), ' ') AS sp FROM q_{name}),
cut_{name} AS (SELECT id, CASE WHEN b < 20 THEN NULL WHEN body = '' THEN '' WHEN length(regexp_extract_all(body, '{tokens}')) <= b THEN body ELSE rtrim(CASE WHEN length(sen) > 0 THEN left(c, st) || sen WHEN strpos(c, ' ') > 0 AND sp > 20 THEN left(c, sp) ELSE c END) END AS t FROM r_{name})"""


_REFIT = f"""{_BUDGET}, {_cut_sql('words', '\\S+', '\\S+')}, {_cut_sql('subwords', '\\S{1,4}', '\\S{1,4}')},
rf AS (SELECT id, CASE WHEN w.t IS NULL OR s.t IS NULL THEN NULL WHEN length(s.t) < length(w.t) THEN s.t ELSE w.t END AS t FROM cut_words w JOIN cut_subwords s USING (id))"""


@query(f"WITH {_REFIT} SELECT id, length(t) AS n_chars, md5(t) AS digest FROM rf")
def refit_body(spark, d):
    return recs(spark, d).select("id", B.refit(F.col("question"), F.col("pairs"), F.col("body")).alias("t")).select("id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


_FITTED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ren_sql("t").items())
_OVER = lambda name, sub: f"SELECT '{name}' AS tokenizer, count(*) AS measured, count(*) FILTER ({_count('question', sub)} + {_count('rendered', sub)} + 3 > 512) AS over FROM ft"


@query(f"WITH {_REFIT}, {FMT}, ft AS (SELECT id, question, format, CASE format {_FITTED} END AS rendered FROM rec JOIN rf USING (id) CROSS JOIN fmt WHERE t IS NOT NULL) {_OVER('words', False)} UNION ALL {_OVER('subwords', True)}")
def check_fit(spark, d):
    fitted = recs(spark, d).withColumn("body", B.refit(F.col("question"), F.col("pairs"), F.col("body"))).filter("body IS NOT NULL")
    return overflows(explode_formats(fitted))


def overflows(rendered, max_tokens: int = B.MAX_TOKENS):
    """tokenizer, measured, over: renderings (question, rendered) that exceed each tokenizer's context; refitted ones must have none."""
    sizes = F.array(*[F.struct(F.lit(n).alias("tokenizer"), (count(F.col("question")) + count(F.col("rendered")) + B.SPECIAL_TOKENS).alias("n")) for n, (count, _) in B.TOKENIZERS.items()])
    long = rendered.select(F.explode(sizes).alias("s")).select("s.tokenizer", "s.n")
    return long.groupBy("tokenizer").agg(F.count(F.lit(1)).alias("measured"), F.count_if(F.col("n") > max_tokens).alias("over"))


# -- scoring that goes on

_OV = REN + r""", o AS (SELECT id, format, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(rendered), '[\p{L}\p{N}_]+')) AS p FROM ren), sc AS (SELECT id, format, coalesce(len(list_intersect(q, p))::DOUBLE / nullif(len(q), 0), 0) AS score FROM o)"""


@query(f"WITH {_OV} SELECT model, format, count(*) AS n, round(avg(score), 6) AS mean FROM sc CROSS JOIN (VALUES ('m1'), ('m2')) m(model) GROUP BY ALL")
def resumed_scores(spark, d):
    """A run that a first one, over every second record and one format, had begun."""
    folder = f"{shared_folder(spark)}/lumiform/scores-{uuid.uuid4().hex}"
    pairs = rendered(spark, d).select("id", "format", "question", F.col("rendered").alias("passage"))
    score = lambda rows, model: scorers.OverlapScorer().score(rows)
    scoring.save_partial(pairs.filter("id % 2 = 0 AND format = 'yaml'"), folder, ["m1"], score)
    report = scoring.save_partial(pairs, folder, ["m1", "m2"], score)
    means = scoring.committed(spark, folder).groupBy("model", "format").agg(F.avg("score").alias("mean"))
    return report.join(means, ["model", "format"]).select("model", "format", "n", "mean")


# -- watched jobs

#: Seconds of silence after which a job that hasn't ended is stale.
STALE = 6 * 3600


@query(f"""WITH l AS (SELECT 'train_m' || (user_id % 3) || '_u' || user_id AS job, epoch_us(ts) // 1000 AS "at", event_id % 51 AS done, 50 AS total, event_type AS label, floor(value)::DOUBLE AS elapsed, floor(value * (50 - event_id % 51) / 50)::DOUBLE AS eta, event_id % 41 = 0 AS failed FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at" DESC, done DESC, label DESC) AS n FROM l), w AS (SELECT max("at") AS mark FROM l)
SELECT job, done, total, label, elapsed, eta, failed, "at", "at" + {STALE * 1000} < mark AND NOT failed AND done < total AS stale FROM r CROSS JOIN w WHERE n = 1""")
def job_watch(spark, d):
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = F.col("event_id") % 51
    line = F.concat(F.lit("done="), done, F.lit(" total=50 label="), "event_type", F.lit(" elapsed="), F.floor("value"), F.lit(" eta="), F.floor(F.col("value") * (50 - done) / 50), F.when(F.col("event_id") % 41 == 0, F.lit(" failed=1")).otherwise(F.lit("")))
    job = F.concat(F.lit("train_m"), F.col("user_id") % 3, F.lit("_u"), "user_id")
    folder = f"{shared_folder(spark)}/lumiform/watch-{uuid.uuid4().hex}"
    return watch.latest_states(spark, stream.select(job.alias("job"), "ts", line.alias("line")), f"{folder}/checkpoint", f"{folder}/out", STALE)


# -- result documents


#: Records of a document.
RECORDS = 5000


@query(f"WITH {_OV} SELECT 'm1' AS model, format, id AS record_id, round(score, 6) AS score FROM sc")
def stored_scores(spark, d):
    """Scores written as JSON documents of up to RECORDS records or so, each with an array for every format, and loaded again."""
    folder = f"{shared_folder(spark)}/lumiform/results-{uuid.uuid4().hex}"
    scored = scorers.OverlapScorer().score(rendered(spark, d).select("id", "format", "question", F.col("rendered").alias("passage")))
    part = F.floor(F.col("id") / RECORDS).alias("part")
    lists = scored.groupBy(part, "format").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("l"))
    documents = lists.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("format", F.transform("l", lambda x: x["score"])))).alias("scores_per_fmt"), F.first(F.transform("l", lambda x: x["id"].cast("string"))).alias("record_ids"))
    documents.select(F.lit("m1").alias("model"), F.lit("untrained").alias("arm"), F.lit(0).alias("seed"), "record_ids", "scores_per_fmt").write.option("maxRecordsPerFile", 1).json(folder)
    return results.load_scores(spark, f"{folder}/*.json").select("model", "format", F.col("record_id").cast("long").alias("record_id"), "score")


def _fold_rows(spark, d):
    """Scores of arms trained with one format held out: the tensor's, a fold for each format."""
    s = gold_scores(spark, d, FOLDS).withColumn("fold", F.substring_index("arm", "-", -1)).withColumn("arm", F.lit("winner"))
    return s.select("model", "arm", "seed", "fold", "record_id", "format", "fpos", "score")


FOLDS = [(m, f"held-{f}", s, 30 + 2 * i + 5 * s + k, 1 + i % 2) for m, k in (("m1", 0), ("m2", 9)) for i, f in enumerate(FORMATS) for s in (0, 1)]
_FOLD = f"""WITH {tensor_sql(FOLDS)}, s AS (SELECT model, split_part(arm, '-', 2) AS fold, seed, query_id, format, fpos, score FROM tensor WHERE cand = 0),
p AS (SELECT a.model, a.fold, a.seed, a.format || '-' || b.format AS pair, a.fold IN (a.format, b.format) AS ood, avg(a.score - b.score) / (stddev_pop(a.score - b.score) + 1e-12) AS d FROM s a JOIN s b ON a.model = b.model AND a.fold = b.fold AND a.seed = b.seed AND a.query_id = b.query_id AND a.fpos < b.fpos GROUP BY ALL)"""


@query(f"{_FOLD}, m AS (SELECT model, seed, fold, ood, max(abs(d)) AS d FROM p GROUP BY ALL) SELECT model, seed, round(avg(d) FILTER (ood), 6) AS ood, round(avg(d) FILTER (NOT ood), 6) AS in_training FROM m GROUP BY ALL")
def fold_scores(spark, d):
    rows = _fold_rows(spark, d)
    sides = [results.mean_max_d(rows, ood).select("model", "seed", F.col("mean_max_d").alias(name)) for ood, name in ((True, "ood"), (False, "in_training"))]
    return sides[0].join(sides[1], ["model", "seed"])
