"""Queries: folds, baselines, scoreboards, diagnostics, residual uncertainty and distribution scores."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions.scalars import normal_points
from ..operators import feature_audit, models, oof, scoring, series, splits, uncertainty
from .resolution import r6
from .views import ARRAYS, HOURS, SAMP, TARGETS, arrays, at, hours, samples, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


H = lambda n: timedelta(hours=n)
PLAN = splits.Plan(datetime(2024, 1, 6), datetime(2024, 1, 27), H(120), H(24), H(12), H(48), H(1), H(1), H(1))

ASSIGNED = f"""{SAMP},
folds as (select cast(k as int) as fold_id, o, timestamp '2024-01-27' as hold from (select k, timestamp '2024-01-06' + to_hours(cast(48 * k as int)) as o from range(20) t(k)) where o + interval 37 hour <= timestamp '2024-01-27'),
assigned as (
  select samp.*, fold_id, case
    when issue_time >= o - interval 121 hour and issue_time < o - interval 1 hour and target_time < o - interval 1 hour and label_known_at <= o - interval 2 hour and feature_known_at <= issue_time then 'train'
    when issue_time >= o and issue_time < o + interval 24 hour and target_time < o + interval 24 hour then 'validation'
    when issue_time >= o + interval 25 hour and issue_time < o + interval 37 hour and target_time < o + interval 37 hour then 'calibration' end as partition
  from samp, folds where target_time < hold)"""


def assigned(spark, d):
    return splits.assign(samples(spark, d), PLAN)


@query(f"with {ASSIGNED} select fold_id, row_id, partition from assigned where partition is not null")
def rolling_origin_assign(spark, d):
    return assigned(spark, d).select("fold_id", "row_id", "partition")


@query("""with h as (select distinct date_trunc('hour', ts) as hour from events), s as (select min(hour) as a, max(hour) as b from h), c as (select a + to_hours(cast(48 * k as int)) as fold_start from s, range(40) t(k))
select fold_start, fold_start + interval 48 hour as forecast_start, count(*) as rows from c join h on hour >= fold_start and hour < fold_start + interval 72 hour group by 1 having count(*) = 72""")
def weekly_folds(spark, d):
    h = table(spark, d, "events").select(series.hour("ts").alias("hour")).distinct()
    return splits.weekly_folds(h, 48, 24, 48)


@query(f"with {SAMP} select row_id, issue_time, round(target, 6) as target from samp where issue_time >= timestamp '2024-01-27'")
def holdout_rows(spark, d):
    return splits.holdout(samples(spark, d), at("2024-01-27 00:00:00")).select("row_id", "issue_time", r6("target").alias("target"))


PERSIST = f"{ASSIGNED}, p as (select fold_id, arg_max(target, target_time) as prediction from assigned where partition = 'train' group by 1), pers as (select fold_id, row_id, 'persistence' as model_id, issue_time, target_time, target as truth, prediction from assigned join p using (fold_id) where partition = 'validation')"
SEASON = "seas as (select v.fold_id, v.row_id, 'seasonal_24h' as model_id, v.issue_time, v.target_time, v.target as truth, t.target as prediction from assigned v left join (select fold_id, target_time, target from assigned where partition = 'train') t on t.fold_id = v.fold_id and t.target_time = v.target_time - interval 24 hour where v.partition = 'validation')"


@query(f"with {PERSIST} select fold_id, row_id, round(truth, 6) as truth, round(prediction, 6) as prediction from pers")
def persistence_oof(spark, d):
    return models.persistence(assigned(spark, d)).select("fold_id", "row_id", r6("truth").alias("truth"), r6("prediction").alias("prediction"))


@query(f"with {ASSIGNED}, {SEASON} select fold_id, row_id, round(truth, 6) as truth, round(prediction, 6) as prediction from seas")
def seasonal_oof(spark, d):
    return models.seasonal(assigned(spark, d), 24).select("fold_id", "row_id", r6("truth").alias("truth"), r6("prediction").alias("prediction"))


COND = f"{ASSIGNED}, t as (select fold_id, hod, list_sort(list(target)) as vs from assigned where partition = 'train' group by 1, 2), cond as (select v.fold_id, v.row_id, v.target as truth, t.vs from assigned v left join t on t.fold_id = v.fold_id and t.hod is not distinct from v.hod where v.partition = 'validation')"


@query(f"with {COND} select fold_id, row_id, len(vs)::int as n, round(vs[1], 6) as low, round(vs[-1], 6) as high from cond")
def conditional_oof(spark, d):
    c = models.conditional(assigned(spark, d), "hod")
    return c.select("fold_id", "row_id", F.size("values").alias("n"), r6(F.array_min("values")).alias("low"), r6(F.array_max("values")).alias("high"))


HOURMEAN = "own as (select fold_id, hod, avg(target) as m from assigned where partition = 'train' group by 1, 2), whole as (select fold_id, avg(target) as g from assigned where partition = 'train' group by 1), hmean as (select v.fold_id, v.row_id, 'hod_mean' as model_id, v.issue_time, v.target_time, v.target as truth, coalesce(m, g) as prediction from assigned v left join own on own.fold_id = v.fold_id and own.hod = v.hod left join whole on whole.fold_id = v.fold_id where v.partition = 'validation')"
#: A candidate that lacks one case is given up: the others are compared on equal cases.
BOTH = f"{PERSIST}, {SEASON}, {HOURMEAN}, every as (select * from pers union all select * from seas union all select * from hmean), ev as (select * from every where model_id not in (select model_id from every where prediction is null))"


def evidence(spark, d):
    return models.eligible(oof.point_candidates(assigned(spark, d), 24, "hod"))


@query(f"with {BOTH} select model_id, count(*) as rows, round(avg(abs(prediction - truth)), 6) as mae, round(sqrt(avg(pow(prediction - truth, 2))), 6) as rmse, round(avg(prediction - truth), 6) as bias from ev group by 1")
def scoreboard_point(spark, d):
    return models.scoreboard(evidence(spark, d)).select("model_id", "rows", *(r6(c).alias(c) for c in ("mae", "rmse", "bias")))


@query(f"""with {COND}, u as (select fold_id, row_id, truth, unnest(vs) as v from cond), q as (select fold_id, row_id, truth, quantile_cont(v, 0.1) as lo, quantile_cont(v, 0.5) as mid, quantile_cont(v, 0.9) as hi from u group by 1, 2, 3)
select fold_id, round(avg(case when truth between lo and hi then 1.0 else 0.0 end), 6) as coverage, round(avg(hi - lo), 6) as sharpness, round(avg(greatest(0.1 * (truth - lo), -0.9 * (truth - lo))), 6) as pinball_10 from q group by 1""")
def scoreboard_distribution(spark, d):
    from ..functions.scalars import array_quantile

    c = models.conditional(assigned(spark, d), "hod").where("values is not null")
    q = c.select("fold_id", F.col("target").alias("truth"), array_quantile(F.col("values"), 0.1).alias("lo"), array_quantile(F.col("values"), 0.9).alias("hi"))
    a = scoring.interval_metrics(q, "truth", "lo", "hi", "fold_id")
    b = q.groupBy("fold_id").agg(F.avg(models.pinball(F.col("truth"), F.col("lo"), 0.1)).alias("pinball_10"))
    return a.join(b, "fold_id").select("fold_id", *(r6(x).alias(x) for x in ("coverage", "sharpness", "pinball_10")))


@query("select lang, round(avg(pow(p - quality, 2)), 6) as brier, count(*) as rows from (select lang, quality, least(n_chars, 5000) / 5000 as p from labels join documents using (doc_id)) group by 1")
def brier_labels(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    p = F.least("n_chars", F.lit(5000)) / 5000
    return rows.groupBy("lang").agg(r6(scoring.brier(F.col("quality"), p)).alias("brier"), F.count(F.lit(1)).alias("rows"))


@query(f"with {BOTH}, s as (select fold_id, model_id, avg(abs(prediction - truth)) as mae from ev group by 1, 2) select fold_id, arg_min(model_id, (mae, model_id)) as model_id, round(min(mae), 6) as mae from s group by 1")
def champion_select(spark, d):
    return models.champion(models.scoreboard(evidence(spark, d), "fold_id", "model_id"), "fold_id").withColumn("mae", r6("mae"))


@query(f"with {BOTH}, s as (select fold_id as week, model_id, avg(abs(prediction - truth)) as mae from ev group by 1, 2), w as (select *, avg(mae) over (partition by model_id order by week rows between unbounded preceding and 1 preceding) as past from s) select week, arg_min(model_id, (past, model_id)) as model_id, round(min(past), 6) as past_mae from w where past is not null group by 1")
def causal_model_choice(spark, d):
    weekly = models.scoreboard(evidence(spark, d), "fold_id", "model_id").withColumnRenamed("fold_id", "week")
    return models.causal_choice(weekly).withColumn("past_mae", r6("past_mae"))


_SIX = ("mae", "rmse", "bias", "coverage")


@query(f"with {BOTH}, s as (select fold_id, model_id, avg(abs(prediction - truth)) as mae, sqrt(avg(pow(prediction - truth, 2))) as rmse, avg(prediction - truth) as bias, avg(case when abs(prediction - truth) <= 5 then 1.0 else 0.0 end) as coverage from ev group by 1, 2) select model_id, "
       + ", ".join(f"round(avg({m}), 6) as {m}_mean, round(quantile_cont({m}, 0.5), 6) as {m}_median, round({'min' if m == 'coverage' else 'max'}({m}), 6) as {m}_worst, round(stddev_pop({m}), 6) as {m}_std" for m in _SIX) + " from s group by 1")
def fold_summary(spark, d):
    e = F.col("prediction") - F.col("truth")
    per = evidence(spark, d).groupBy("fold_id", "model_id").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.when(F.abs(e) <= 5, 1.0).otherwise(0.0)).alias("coverage"))
    out = models.fold_summary(per, "model_id", metrics=_SIX, worst={"coverage": "min"})
    return out.select("model_id", *(r6(c).alias(c) for c in out.columns[1:]))


@query(f"with {BOTH}, s as (select fold_id, model_id as scenario, avg(abs(prediction - truth)) as mae from ev group by 1, 2) select a.fold_id, round(a.mae, 6) as base_mae, round(b.mae, 6) as candidate_mae, round(a.mae - b.mae, 6) as gain from s a join s b using (fold_id) where a.scenario = 'persistence' and b.scenario = 'hod_mean'")
def ablation_delta(spark, d):
    board = models.scoreboard(evidence(spark, d), "fold_id", "model_id").withColumnRenamed("model_id", "scenario")
    out = models.ablation(board, "persistence", "hod_mean", "fold_id")
    return out.select("fold_id", *(r6(c).alias(c) for c in ("base_mae", "candidate_mae", "gain")))


PEARSON = "case when count(*) >= 2 then case when stddev_pop({0}) * stddev_pop({1}) = 0 then 0.0 else covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) end end"


@query(f"""with p as (select event_type, floor(value) as x, cast(json_extract_string(props, '$.k') as double) as y from events),
r as (select *, rank() over (partition by event_type order by x) + (count(*) over (partition by event_type, x) - 1) / 2.0 as rx, rank() over (partition by event_type order by y) + (count(*) over (partition by event_type, y) - 1) / 2.0 as ry from p)
select event_type, count(*) as n, round({PEARSON.format('x', 'y')}, 6) as pearson, round({PEARSON.format('rx', 'ry')}, 6) as spearman from r group by 1""")
def pearson_spearman(spark, d):
    rows = table(spark, d, "events").select("event_type", F.floor("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return feature_audit.correlations(rows, "v", "k", "event_type").select("event_type", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("""with p as (select event_type, value as x, cast(json_extract_string(props, '$.k') as double) as y from events),
e as (select event_type, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by 1),
b as (select event_type, least(4, floor((x - x0) / (x1 - x0) * 5)) as bx, least(4, floor((y - y0) / (y1 - y0) * 5)) as by_ from p join e using (event_type)),
c as (select event_type, bx, by_, count(*) as c from b group by 1, 2, 3),
m as (select *, sum(c) over (partition by event_type, bx) as cx, sum(c) over (partition by event_type, by_) as cy, sum(c) over (partition by event_type) as n from c)
select event_type, round(sum(c / n * ln(c * n / (cx * cy))), 6) as mutual_information from m group by 1""")
def mutual_information(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return feature_audit.mutual_information(rows, "value", "k", "event_type").withColumn("mutual_information", r6("mutual_information"))


@query(f"with {ASSIGNED}, o as (select fold_id, hod, avg(target) as m from assigned where partition = 'train' group by 1, 2), a as (select fold_id, avg(target) as g from assigned where partition = 'train' group by 1) select v.fold_id, round(avg(abs(coalesce(o.m, a.g) - target)), 6) as mae, count(*) as rows from assigned v left join o on o.fold_id = v.fold_id and o.hod is not distinct from v.hod join a on a.fold_id = v.fold_id where partition = 'validation' group by 1")
def univariate_oof(spark, d):
    return feature_audit.univariate_oof(assigned(spark, d), "hod").withColumn("mae", r6("mae"))


RESID = f"{HOURS}, r as (select a.source_id as target, a.hour, a.value - b.value as residual from hours a join hours b on b.source_id = a.source_id and b.hour = a.hour - interval 1 hour), panel as (select c.hour, " + ", ".join(f"{t[0]}.residual as {t}" for t in TARGETS) + " from r c " + " ".join(f"join r {t[0]} on {t[0]}.hour = c.hour and {t[0]}.target = '{t}'" for t in TARGETS[1:]) + " where c.target = 'click')"


def residuals(spark, d):
    h = hours(spark, d)
    wide = series.exact_lag(h, ["source_id"], 1)
    return wide.where("lag_1 is not null and value is not null").select(F.col("source_id").alias("target"), "hour", (F.col("value") - F.col("lag_1")).alias("residual")).where(F.col("target").isin(*TARGETS))


def panel(spark, d):
    return uncertainty.residual_panel(residuals(spark, d), TARGETS, "hour")


@query(f"with {RESID} select hour, " + ", ".join(f"round({t}, 6) as {t}" for t in TARGETS) + " from panel")
def residual_panel_join(spark, d):
    return panel(spark, d).select("hour", *(r6(t).alias(t) for t in TARGETS))


PAIRS = uncertainty.pair_names(TARGETS)
COVS = ", ".join([f"round(avg({t}), 6) as bias_{t}" for t in TARGETS] + [f"round(covar_samp({a}, {b}), 6) as cov_{a}_{b}" for a, b in PAIRS])


@query(f"with {RESID} select count(*) as n, {COVS} from panel")
def bias_covariance(spark, d):
    out = uncertainty.covariance(panel(spark, d), TARGETS)
    return out.select("n", *(r6(c).alias(c) for c in out.columns[1:]))


@query(f"with {RESID} select hour(hour)::int as bucket, count(*) as n, {COVS} from panel group by 1")
def covariance_by_hour(spark, d):
    rows = panel(spark, d).withColumn("bucket", uncertainty.bucket("hour", target_time="hour"))
    out = uncertainty.covariance(rows, TARGETS, "bucket")
    return out.select("bucket", "n", *(r6(c).alias(c) for c in out.columns[2:]))


_SQ = " + ".join(f"{1 if a == b else 2} * pow(c.cov_{a}_{b} - w.cov_{a}_{b}, 2)" for a, b in PAIRS)
_NORM = " + ".join(f"{1 if a == b else 2} * pow(w.cov_{a}_{b}, 2)" for a, b in PAIRS)
_COV = ", ".join(f"covar_samp({a}, {b}) as cov_{a}_{b}" for a, b in PAIRS)


@query(f"with {RESID}, k as (select *, (row_number() over (order by hour) - 1) // 50 as chunk from panel), c as (select chunk, count(*) as n, {_COV} from k group by 1), w as (select {_COV} from panel) select chunk, round(sqrt(({_SQ}) / ({_NORM})), 6) as deviation from c, w where n = 50")
def covariance_stability(spark, d):
    return uncertainty.stability(panel(spark, d), TARGETS, "hour", 50).withColumn("deviation", r6("deviation"))


@query(f"with {RESID} select target, " + "unnest([" + ", ".join(f"{{'p': {p!r}::double, 'z': {z!r}::double, 'q': quantile_cont(residual, {p!r})}}" for p, z in normal_points()) + f"]) as u from r where target in ({', '.join(repr(t) for t in TARGETS)}) group by 1")
def _qq(spark, d):
    return uncertainty.qq(residuals(spark, d), "residual", "target")


QUERIES["qq_diagnostic"] = (lambda spark, d: _qq(spark, d).select("target", r6("probability").alias("probability"), r6("normal").alias("normal"), r6("sample").alias("sample")), f"select target, round(u.p, 6) as probability, round(u.z, 6) as normal, round(u.q, 6) as sample from ({QUERIES.pop('_qq')[1]})")

SCORED = """stat as (select vec_id, truth, list_min(samples)::double as lo, list_max(samples)::double as hi, list_avg(samples) as m, list_stddev_pop(samples) as s from pairs),
scored as (select vec_id, case when truth between lo and hi then 0.2 + 0.45 * case when s = 0 then case when truth = m then 1 else 0 end else greatest(0, 1 - abs(truth - m) / (3 * s)) end + 0.35 * case when s = 0 then 1 else (hi - lo) / (hi - lo + 2 * s) end else 0.0 end as score from stat)"""


@query(f"with {ARRAYS}, {SCORED} select vec_id, round(score, 6)::double as score from scored")
def distribution_score(spark, d):
    return arrays(spark, d).select("vec_id", r6(scoring.distribution_score(F.col("samples"), F.col("truth"))).alias("score"))


@query(f"with {ARRAYS}, {SCORED} select count(*) as rows, round(avg(score), 6)::double as score, round(100 * least(1, greatest(0, avg(score))), 6)::double as percent from scored")
def table_score(spark, d):
    from ..functions.scalars import percent

    a = arrays(spark, d)
    s = scoring.score_table(a.select("vec_id", F.col("samples").alias("x")), a.select("vec_id", F.col("truth").alias("x")), ["x"], "vec_id")
    return s.agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("score")).alias("score"), r6(percent(F.avg("score"))).alias("percent"))


@query("""with a as (select vec_id, embedding from embeddings) select count(*) as rows, count(distinct vec_id) as keys, count(*) filter (embedding is null or len(embedding) <> 64) as broken,
(select count(*) from a where vec_id not in (select vec_id from a where vec_id % 50 <> 0)) as unmatched from a""")
def submission_guard(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("int")).alias("x"))
    left = scoring.unmatched_keys(e, e.where("vec_id % 50 <> 0"), "vec_id").agg(F.count(F.lit(1)).alias("unmatched"))
    return scoring.submission_counts(e, ["x"], "vec_id", 64).crossJoin(left)


@query("with v as (select event_type, least(20, greatest(1, floor(value / 5) + 1))::bigint as bin from events where value is not null), c as (select event_type, bin, count(*) as n from v group by 1, 2) select event_type, bin, n, round(n / sum(n) over (partition by event_type), 6) as p from c")
def histogram_bins(spark, d):
    return scoring.histogram(table(spark, d, "events"), "value", 0.0, 100.0, 20, "event_type").withColumn("p", r6("p"))


@query("select vec_id, i::int as at, max(v) over (partition by vec_id order by i rows unbounded preceding) as q from (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as v from embeddings)")
def quantile_repair(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", scoring.repaired_quantiles(F.transform("embedding", lambda x: x.cast("double"))).alias("q"))
    return e.select("vec_id", F.posexplode("q").alias("at", "q")).select("vec_id", (F.col("at") + 1).alias("at"), "q")


@query("select l_returnflag, round(avg(case when l_discount - 0.05 >= 0 then 1.0 else 0.0 end), 6) as export, round(1 - avg(case when l_discount - 0.05 >= 0 then 1.0 else 0.0 end), 6) as import from lineitem group by 1")
def sign_probability(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("v"))
    return scoring.sign_probabilities(rows, "v", "l_returnflag").select("l_returnflag", r6("export").alias("export"), r6("import").alias("import"))


@query(f"with {BOTH}, s as (select fold_id as week, model_id as method, avg(abs(prediction - truth)) as score from ev group by 1, 2), b as (select week, score as base from s where method = 'persistence') select method, count(*) as weeks, count(*) filter (score <= base) as wins, round(avg(score), 6) as mean_score, method = 'persistence' or count(*) filter (score <= base) * 2 > count(*) as keep from s join b using (week) group by 1")
def paired_wins(spark, d):
    weekly = models.scoreboard(evidence(spark, d), "fold_id", "model_id").select(F.col("fold_id").alias("week"), F.col("model_id").alias("method"), F.col("mae").alias("score"))
    return uncertainty.paired_wins(weekly, "persistence").withColumn("mean_score", r6("mean_score"))


#: Two features in closed form: each filled with its mean, scaled by its deviation, the slopes penalised by 10.
_RIDGE = f"""{ASSIGNED}, t as (select * from assigned where partition = 'train' and target is not null),
m as (select fold_id, count(*) as n, avg(hod) as ma, coalesce(nullif(stddev_pop(hod), 0), 1) as sa, avg(now_value) as mb, coalesce(nullif(stddev_pop(now_value), 0), 1) as sb, avg(target) as my from t group by 1),
z as (select fold_id, (hod - ma) / sa as a, (coalesce(now_value, mb) - mb) / sb as b, target - my as y from t join m using (fold_id)),
g as (select fold_id, sum(a * a) + 10 as aa, sum(a * b) as ab, sum(b * b) + 10 as bb, sum(a * y) as ay, sum(b * y) as by_ from z group by 1),
c as (select fold_id, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as cb from g)
select v.fold_id, v.row_id, 'ridge' as model_id, v.issue_time, v.target_time, round(v.target, 6) as truth, round(my + ca * (v.hod - ma) / sa + cb * (coalesce(v.now_value, mb) - mb) / sb, 6) as prediction
from assigned v left join m on m.fold_id = v.fold_id and m.n >= 2 left join c on c.fold_id = v.fold_id where v.partition = 'validation'"""


@query(f"with {_RIDGE}")
def ridge_oof(spark, d):
    return models.fitted(assigned(spark, d), "ridge", models.Ridge).withColumns({"truth": r6("truth"), "prediction": r6("prediction")})


@query()
def boosted_oof(spark, d):
    return models.fitted(assigned(spark, d), "boosted", models.BoostedTrees)


@query()
def joint_samples(spark, d):
    p = panel(spark, d)
    fit = uncertainty.covariance(p, TARGETS).first()
    cov = [[fit[f"cov_{a}_{b}" if (a, b) in PAIRS else f"cov_{b}_{a}"] for b in TARGETS] for a in TARGETS]
    return uncertainty.joint_samples(p, TARGETS, [fit[f"bias_{t}"] for t in TARGETS], cov, key="hour", seed=20260910)
