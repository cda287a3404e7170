"""Queries: the backtest of four targets end to end, from assigned samples to the joint handoff and its diagnostics."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.scalars import array_quantile
from ..operators import feature_audit, models, oof, pit, quality, scoring, series, splits, uncertainty
from .evaluation import ASSIGNED, PAIRS, PLAN
from .resolution import I, r6
from .views import ARRAYS, HOURS, OBS, SAMP, TARGETS, TSAMP, arrays, at, hours, observations, table, target_samples

QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


VERSIONS = {"persistence": "1", "seasonal_24h": "1", "hod_mean": "1"}
FEATURES = hashlib.sha256(b"hod,now_value").hexdigest()

TASSIGNED = ASSIGNED.replace(SAMP, TSAMP).replace("select samp.*", "select tsamp.*").replace("from samp, folds", "from tsamp, folds")
TEV = f"""{TASSIGNED},
lastv as (select fold_id, target_name, arg_max(target, target_time) as p from assigned where partition = 'train' group by 1, 2),
own as (select fold_id, target_name, hod, avg(target) as m from assigned where partition = 'train' group by 1, 2, 3),
whole as (select fold_id, target_name, avg(target) as g from assigned where partition = 'train' group by 1, 2),
val as (select * from assigned where partition = 'validation'),
every as (
  select fold_id, target_name, row_id, 'persistence' as model_id, issue_time, target_time, target as truth, p as prediction from val left join lastv using (fold_id, target_name)
  union all select v.fold_id, v.target_name, v.row_id, 'seasonal_24h', v.issue_time, v.target_time, v.target, t.target from val v left join (select * from assigned where partition = 'train') t on t.fold_id = v.fold_id and t.target_name = v.target_name and t.target_time = v.target_time - interval 24 hour
  union all select fold_id, target_name, row_id, 'hod_mean', issue_time, target_time, target, coalesce(m, g) from val left join own using (fold_id, target_name, hod) left join whole using (fold_id, target_name)),
ev as (select * from every where (target_name, model_id) not in (select (target_name, model_id) from every where prediction is null)),
score as (select fold_id, target_name, model_id, count(*) as rows, avg(abs(prediction - truth)) as mae, sqrt(avg(pow(prediction - truth, 2))) as rmse, avg(prediction - truth) as bias from ev group by 1, 2, 3),
champ as (select target_name, arg_min(model_id, (mae_mean, model_id)) as model_id from (select target_name, model_id, avg(mae) as mae_mean from score group by 1, 2) group by 1),
sel as (select ev.* from ev join champ using (target_name, model_id)),
joint as (select max(target_time) as timestamp, fold_id, 1 as horizon, max(issue_time) as issue_time, {", ".join(f"max(case when target_name = '{t}' then truth end) as {t}_actual, max(case when target_name = '{t}' then prediction end) as {t}_pred" for t in TARGETS)} from sel group by fold_id, row_id)"""
_LONG = "long as (" + " union all ".join(f"select timestamp, '{t}' as target, {t}_actual - {t}_pred as r from joint" for t in TARGETS) + ")"


def assigned(spark, d):
    return splits.assign(target_samples(spark, d), PLAN)


def every(spark, d):
    return oof.point_candidates(assigned(spark, d), 24, "hod", "target_name")


def evidence(spark, d):
    return models.eligible(every(spark, d), "target_name")


def board(spark, d):
    return models.scoreboard(evidence(spark, d), "fold_id", "target_name", "model_id")


def champion_rows(spark, d):
    e = evidence(spark, d)
    per = models.scoreboard(e, "fold_id", "target_name", "model_id")
    best = oof.champions(models.fold_summary(per, "target_name", "model_id"), "target_name")
    return oof.selected(e, best, "target_name")


def handoff(spark, d):
    return oof.require_handoff(oof.joint(champion_rows(spark, d), "target_name", TARGETS), TARGETS)


@query(f"with {TEV} select fold_id, target_name, model_id, rows, round(mae, 6) as mae, round(rmse, 6) as rmse, round(bias, 6) as bias from score")
def scenario_scores(spark, d):
    return board(spark, d).select("fold_id", "target_name", "model_id", "rows", *(r6(c).alias(c) for c in ("mae", "rmse", "bias")))


@query(f"with {TEV} select target_name, model_id, " + ", ".join(f"round(avg({m}), 6) as {m}_mean, round(quantile_cont({m}, 0.5), 6) as {m}_median, round(max({m}), 6) as {m}_worst, round(stddev_pop({m}), 6) as {m}_std" for m in ("mae", "rmse", "bias")) + " from score group by 1, 2")
def scenario_summary(spark, d):
    out = models.fold_summary(board(spark, d), "target_name", "model_id", metrics=("mae", "rmse", "bias"))
    return out.select("target_name", "model_id", *(r6(c).alias(c) for c in out.columns[2:]))


@query(f"with {TEV} select target_name, model_id, round(1 / (1 + stddev_pop(mae)), 6) as stability from score group by 1, 2")
def fold_stability(spark, d):
    return models.stability(board(spark, d), "mae", "target_name", "model_id").withColumn("stability", r6("stability"))


@query(f"with {TEV} select target_name, model_id, fold_id, row_id, round(truth, 6) as truth, round(prediction, 6) as prediction from sel")
def champion_predictions(spark, d):
    return champion_rows(spark, d).select("target_name", "model_id", "fold_id", "row_id", r6("truth").alias("truth"), r6("prediction").alias("prediction"))


@query(f"with {TEV} select timestamp, fold_id, horizon, issue_time, " + ", ".join(f"round({t}_actual, 6) as {t}_actual, round({t}_pred, 6) as {t}_pred, round({t}_actual - {t}_pred, 6) as {t}_residual" for t in TARGETS) + " from joint")
def oof_handoff(spark, d):
    rows = handoff(spark, d)
    return rows.select(*rows.columns[:4], *(r6(c).alias(c) for c in rows.columns[4:]))


@query(f"with {TEV}, {_LONG} select target, count(*) as count, round(avg(abs(r)), 6) as mae, round(sqrt(avg(r * r)), 6) as rmse, round(-avg(r), 6) as bias, round(avg(r), 6) as residual_mean, round(stddev_pop(r), 6) as residual_std from long group by 1")
def oof_residual_summary(spark, d):
    out = oof.residual_summary(handoff(spark, d), TARGETS)
    return out.select("target", "count", *(r6(c).alias(c) for c in out.columns[2:]))


def panel(spark, d):
    return handoff(spark, d).select("timestamp", "fold_id", *(F.col(f"{t}_residual").alias(t) for t in TARGETS))


def settled_panel(spark, d):
    """The panel, computed once: what follows reads it several times."""
    rows = panel(spark, d)
    return rows.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else rows.persist()


_PANEL = "panel as (select timestamp, fold_id, " + ", ".join(f"{t}_actual - {t}_pred as {t}" for t in TARGETS) + " from joint)"


@query(f"with {TEV}, {_PANEL}, c as (select " + ", ".join(f"round(corr({a}, {b}), 6) as r_{a}_{b}" for a, b in PAIRS if a != b) + " from panel) " + " union all ".join(f"select '{a}' as a, '{b}' as b, " + ("1.0::double" if a == b else f"r_{a}_{b}") + " as r from c" for a, b in PAIRS))
def residual_correlation(spark, d):
    return uncertainty.correlation(panel(spark, d), TARGETS).withColumn("r", r6("r"))


@query(f"with {TEV}, {_PANEL} select hour(timestamp)::int as bucket, count(*) as n, " + ", ".join(f"round(stddev_pop({t}), 6) as {t}" for t in TARGETS) + " from panel group by 1")
def residual_scale_by_hour(spark, d):
    rows = panel(spark, d).withColumn("bucket", uncertainty.bucket("hour", target_time="timestamp"))
    out = uncertainty.residual_scale(rows, TARGETS, "bucket")
    return out.select("bucket", "n", *(r6(t).alias(t) for t in TARGETS))


_HASH = "sha256(concat_ws(':', count(*)::varchar, sum(('0x' || substr(h, 1, 15))::bigint::hugeint)::varchar, sum(('0x' || substr(h, 16, 15))::bigint::hugeint)::varchar))"


@query(f"with {TASSIGNED} select fold_id, target_name, {_HASH} as hash from (select fold_id, target_name, sha256(row_id || '|' || strftime(target_time, '%Y-%m-%d %H:%M:%S')) as h from assigned where partition = 'train') group by 1, 2")
def fold_data_hash(spark, d):
    return oof.set_hash(assigned(spark, d).where("partition = 'train'"), ["row_id", "target_time"], "fold_id", "target_name")


@query(f"with {TEV} select target_name, model_id, count(*) filter (prediction is null) as missing, 0::bigint as extra from every group by 1, 2")
def oof_coverage(spark, d):
    return oof.coverage(every(spark, d), assigned(spark, d), "target_name")


_CHECKS = {
    "no records": "0", "unknown fold": "count(*) filter (hod = 2)", "no validation case": "count(*) filter (hod = 2)", "timestamps differ": "count(*) filter (hod = 9)", "truth differs": "count(*) filter (hod = 11)", "chronology": "count(*) filter (hod = 9)",
    "training cutoff differs": "count(*) filter (hod = 2)", "training rows differ": "count(*) filter (hod in (2, 13))", "features differ": "count(*) filter (hod = 15)", "no digest": "count(*) filter (hod = 13)",
    "unregistered candidate": "count(*) filter (hod = 17)", "version differs": "count(*) filter (hod = 5)", "no finite prediction": "count(*) filter (prediction is null or hod = 3)",
    "predicted twice": "count(*) filter (hod = 7) // 2 + count(*) filter (hod = 17) // 3", "sample differs between folds": "0",
}


@query(f"with {TEV}, b as (select *, extract(hour from issue_time) as hod from every), rec as (select * from b union all select * from b where hod = 7) select unnest([" + ", ".join(f"{{'check': '{k}', 'broken': ({v})::bigint}}" for k, v in _CHECKS.items()) + "], recursive := true) from rec")
def oof_revalidate(spark, d):
    """Evidence that is broken on purpose at some hours of the day, one rule each."""
    a = assigned(spark, d)
    good = oof.execute(a, every(spark, d), PLAN, VERSIONS, FEATURES, "target_name")
    hod = F.hour("issue_time")
    one = F.make_dt_interval(F.lit(0), F.lit(2))
    broken = good.unionByName(good.where(hod == 7)).withColumns({
        "fold_id": F.when(hod == 2, 99).otherwise(F.col("fold_id")), "target_time": F.when(hod == 9, F.col("target_time") - one).otherwise(F.col("target_time")), "truth": F.when(hod == 11, F.col("truth") + 1).otherwise(F.col("truth")),
        "training_hash": F.when(hod == 13, "none").otherwise(F.col("training_hash")), "feature_hash": F.when(hod == 15, "0" * 64).otherwise(F.col("feature_hash")), "model_id": F.when(hod == 17, "other").otherwise(F.col("model_id")),
        "version": F.when(hod == 5, "2").otherwise(F.col("version")), "prediction": F.when(hod == 3, float("nan")).otherwise(F.col("prediction")),
    })
    return oof.revalidate(broken, a, PLAN, VERSIONS, FEATURES, "target_name")


@query(f"with {TEV} select fold_id, date_diff('hour', issue_time, target_time)::int + (extract(hour from issue_time) % 6)::int as horizon, round(avg(abs(prediction - truth)), 6) as mae, count(*) as rows from sel group by 1, 2")
def horizon_mae(spark, d):
    rows = champion_rows(spark, d).withColumn("horizon", ((quality.micros("target_time") - quality.micros("issue_time")) / 3_600_000_000).cast("int") + F.hour("issue_time") % 6)
    return models.scoreboard(rows, "fold_id", "horizon").select("fold_id", "horizon", r6("mae").alias("mae"), "rows")


@query(f"with {TEV}, w as (select fold_id as week, target_name, model_id, mae as score from score), h as (select max(week) as last from w) select target_name, model_id, count(*) filter (week < last) as weeks, round(avg(score) filter (week < last), 6) as validation_score, round(max(score) filter (week = last), 6) as holdout_score, round(max(score) filter (week = last) - avg(score) filter (week < last), 6) as gap from w, h group by 1, 2")
def rolling_validation(spark, d):
    weekly = board(spark, d).select(F.col("fold_id").alias("week"), "target_name", "model_id", F.col("mae").alias("score"))
    out = oof.week_summary(weekly, len(PLAN.folds()) - 1, "target_name", "model_id")
    return out.select("target_name", "model_id", "weeks", *(r6(c).alias(c) for c in ("validation_score", "holdout_score", "gap")))


@query(f"with {TEV}, w as (select fold_id as week, model_id as method, avg(mae) as score from score group by 1, 2), p as (select a.week, b.method, avg(b.score) as past, count(*) as n from (select distinct week from w) a left join w b on b.week < a.week group by 1, 2) select week, case when max(coalesce(n, 0)) < 2 then 'persistence' else arg_min(method, (past, method)) end as method from p group by 1")
def weekly_method_choice(spark, d):
    weekly = board(spark, d).groupBy(F.col("fold_id").alias("week"), F.col("model_id").alias("method")).agg(F.avg("mae").alias("score"))
    return uncertainty.method_choice(weekly, "persistence", 2)


_VALUES = f"{TEV}, q0 as (select v.fold_id, v.target_name, v.row_id, v.target as truth, quantile_cont(t.target, 0.05) as lo, quantile_cont(t.target, 0.5) as mid, quantile_cont(t.target, 0.95) as hi from val v join assigned t on t.partition = 'train' and t.fold_id = v.fold_id and t.target_name = v.target_name and t.hod = v.hod group by 1, 2, 3, 4)"


@query(f"with {_VALUES}, m as (select fold_id as week, target_name, avg(case when truth between lo and hi then 1.0 else 0.0 end) as capture, avg(hi - lo) as sharpness, avg(abs(mid - truth)) as mae, avg(mid - truth) as bias from q0 group by 1, 2) select week, round(avg(capture), 6) as capture, round(avg(sharpness), 6) as sharpness, round(avg(mae), 6) as mae, round(avg(bias), 6) as bias, round(avg(mae) + 0.5 * avg(sharpness) + 10 * greatest(0, 0.9 - avg(capture)), 6) as score from m group by 1")
def week_score(spark, d):
    """Capture, sharpness, mae, bias and loss of each week, from the training labels of the same hour."""
    c = models.conditional(assigned(spark, d), "target_name", "hod").where("values is not null")
    q = c.select(F.col("fold_id").alias("week"), "target_name", F.col("target").alias("truth"), *(array_quantile(F.col("values"), p).alias(n) for n, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95))))
    per = scoring.week_metrics(q, "truth", "lo", "mid", "hi", "week", "target_name")
    out = per.groupBy("week").agg(*(F.avg(x).alias(x) for x in ("capture", "sharpness", "mae", "bias")))
    return out.select("week", *(r6(x).alias(x) for x in ("capture", "sharpness", "mae", "bias")), r6(uncertainty.placeholder_loss(F.col("mae"), F.col("sharpness"), F.col("capture"))).alias("score"))


@query(f"with {ARRAYS} select round(sqrt(avg(pow(list_avg(samples) - truth, 2))), 6) as rmse from pairs")
def sample_mean_rmse(spark, d):
    return scoring.mean_rmse(arrays(spark, d), [("samples", "truth")]).withColumn("rmse", r6("rmse"))


_FALL = {"exact_168h": 168, "nearby_167h": 167, "nearby_169h": 169, "previous_week_336h": 336}


def _fallback(spark, d):
    from .timeseries import _ahead

    h = hours(spark, d)
    return series.seasonal_fallback(_ahead(spark, h, 900), h, ["source_id"], at()), h


_FB = f"""{HOURS}, k as (select * from hours where hour <= {I} and value is not null), t as (select s.source_id, g.h as hour from (select distinct source_id from hours) s, generate_series({I} + interval 1 hour, {I} + interval 900 hour, interval 1 hour) g(h)),
l as (select source_id, arg_max(value, hour) as latest from k group by 1),
j as (select t.source_id, t.hour, {", ".join(f"max(case when k.hour = t.hour - interval {h} hour then k.value end) as v{h}" for h in _FALL.values())}, any_value(latest) as latest
  from t left join k on k.source_id = t.source_id and k.hour in ({", ".join(f"t.hour - interval {h} hour" for h in _FALL.values())}) left join l on l.source_id = t.source_id group by 1, 2),
f as (select source_id, hour, coalesce({", ".join(f"v{h}" for h in _FALL.values())}, latest) as value, case {" ".join(f"when v{h} is not null then '{n}'" for n, h in _FALL.items())} when latest is not null then 'latest_causal' end as label from j)"""


@query(f"with {_FB}, n as (select unnest({[*_FALL, 'latest_causal']!r}) as label) select n.label, count(f.label) as rows from n left join f using (label) group by 1")
def fallback_histogram(spark, d):
    return series.label_histogram(_fallback(spark, d)[0], "label", [*_FALL, "latest_causal"])


@query(f"with {_FB}, m as (select f.source_id, f.hour, quantile_cont(k.value, 0.5) as median from f left join k on k.source_id = f.source_id and k.hour in (f.hour - interval 504 hour, f.hour - interval 672 hour, f.hour - interval 840 hour) group by 1, 2) select source_id, hour, label, round(case when label = 'latest_causal' then coalesce(median, value) else value end, 6) as value from f join m using (source_id, hour)")
def long_lead_fallback(spark, d):
    rows, h = _fallback(spark, d)
    return series.long_lead_fallback(rows, h.where(F.col("hour") <= at()), ["source_id"]).select("source_id", "hour", "label", r6("value").alias("value"))


@query(f"""with {HOURS}, w as (select a.source_id, a.hour, {", ".join(f"l{k}.value as lag_{k}" for k in (1, 2, 3, 24, 168))} from hours a {" ".join(f"left join hours l{k} on l{k}.source_id = a.source_id and l{k}.hour = a.hour - interval {k} hour" for k in (1, 2, 3, 24, 168))})
select source_id, hour, {", ".join(f"round(lag_{k}, 6) as lag_{k}" for k in (1, 24, 168))}, round(lag_1 - lag_2, 6) as ramp_1, round(case when lag_1 is not null and lag_2 is not null and lag_3 is not null then (lag_1 + lag_2 + lag_3) / 3 end, 6) as mean_3, round(sin(2 * pi() * hour(hour) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(hour) / 24), 6) as hour_cos, round(sin(2 * pi() * (isodow(hour) - 1) / 7), 6) as weekday_sin, round(cos(2 * pi() * (isodow(hour) - 1) / 7), 6) as weekday_cos, isodow(hour) >= 6 as weekend from w""")
def feature_vector(spark, d):
    out = series.feature_vector(hours(spark, d), ["source_id"], lags=(1, 24, 168), rolling=(3,))
    names = ["lag_1", "lag_24", "lag_168", "ramp_1", "mean_3", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]
    return out.select("source_id", "hour", *((r6(n) + 0.0).alias(n) for n in names), "weekend")


@query(f"with {HOURS} select a.source_id, a.hour, round(b.value, 6) as value, round(b.value - c.value, 6) as ramp from hours a left join hours b on b.source_id = a.source_id and b.hour = a.hour - interval 1 hour left join hours c on c.source_id = a.source_id and c.hour = a.hour - interval 2 hour")
def source_value_ramp(spark, d):
    return series.value_ramp(hours(spark, d), ["source_id"], 1).select("source_id", "hour", r6("value").alias("value"), r6("ramp").alias("ramp"))


@query(f"""with {OBS}, cut as (select timestamp '2024-01-12' as c), fit as (select source_id, avg(value) as m, coalesce(nullif(stddev_pop(value), 0), 1) as s, max(known_at) as fitted from obs, cut where known_at <= c and event_time <= c group by 1)
select event_id, round((value - m) / s, 6) as value, greatest(known_at, c) as known_at, array_to_string(list_sort([source_id || ':fit', source_id || ':' || unit]), ',') as lineage from obs join fit using (source_id), cut where event_time > c""")
def fold_transform(spark, d):
    obs = observations(spark, d).withColumn("partition", F.when((F.col("known_at") <= at("2024-01-12 00:00:00")) & (F.col("event_time") <= at("2024-01-12 00:00:00")), "train"))
    fit = series.fit_scale(obs.where("partition = 'train'"), "value", at("2024-01-12 00:00:00"), "source_id")
    rows = obs.where(F.col("event_time") > at("2024-01-12 00:00:00")).withColumn("sources", F.array(F.concat_ws(":", "source_id", "unit")))
    out = series.apply_scale(rows, fit, "value", "source_id")
    return out.select("event_id", r6("value").alias("value"), "known_at", F.array_join("sources", ",").alias("lineage"))


@query("select date_trunc('hour', o_orderdate + to_minutes(cast(15 * (o_orderkey % 5) as int))) as hour, count(*) as rows from orders group by 1 having count(*) = 4 and count(distinct extract(minute from o_orderdate + to_minutes(cast(15 * (o_orderkey % 5) as int)))) = 4")
def complete_hour_index(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (15 * (F.col("o_orderkey") % 5)).cast("int"))).alias("t"))
    return series.complete_hours(rows, "t")


@query(f"with {OBS}, m as (select * from obs where event_id % 97 <> 0 and known_at <= {I} qualify row_number() over (partition by source_id, source_record_id order by revision_sequence desc) = 1) select source_id, source_record_id, revision_sequence, event_id from m where event_time between {I} - interval 72 hour and {I}")
def dataset_asof(spark, d):
    obs = observations(spark, d).where("event_id % 97 <> 0")
    members = obs.select("source_id").distinct().withColumn("units", F.array(F.lit("MW")))
    return pit.in_horizon(pit.dataset_as_of(obs, members, at()), at(), -72, 0).select("source_id", "source_record_id", "revision_sequence", "event_id")


@query("select event_type, round(avg(value), 6) as value from events where event_type in (select distinct lower(x) from (values ('CLICK'), ('view'), ('view')) t(x)) group by 1")
def authorised_rows(spark, d):
    allowed = spark.createDataFrame([("CLICK",), ("view",), ("view",)], "event_type string").select(F.lower("event_type").alias("event_type"))
    return quality.authorised(table(spark, d, "events"), allowed, "event_type").groupBy("event_type").agg(r6(F.avg("value")).alias("value"))


@query("select n_name as feature from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 3 = 0)")
def unregistered_features(spark, d):
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("feature"))
    have = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("key"))
    return scoring.unmatched_keys(wanted, have, "key").join(wanted, "key").select("feature")


_TEXT = "case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 3 then 'soon' end"


@query(f"with t as (select event_type as source_id, event_id, {_TEXT} as x from events) select source_id, count(*) filter (x = 'soon') as unparseable, count(*) filter (event_id % 5 = 2) as naive, count(distinct event_id % 5) filter (event_id % 5 < 2) > 1 as mixed_offsets from t group by 1")
def timestamp_hygiene(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+01:00"))).when(k == 2, iso).when(k == 3, "soon")
    return quality.timestamp_hygiene(table(spark, d, "events").select(F.col("event_type").alias("source_id"), text.alias("x")), "x")


@query("""with p as (select event_type, floor(value) as x, cast(json_extract_string(props, '$.k') as double) as y from events),
r as (select *, rank() over (partition by event_type order by x) + (count(*) over (partition by event_type, x) - 1) / 2.0 as rx, rank() over (partition by event_type order by y) + (count(*) over (partition by event_type, y) - 1) / 2.0 as ry from p),
c as (select event_type, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r group by 1),
e as (select event_type, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by 1),
b as (select event_type, least(4, floor((x - x0) / (x1 - x0) * 5)) as bx, least(4, floor((y - y0) / (y1 - y0) * 5)) as by_ from p join e using (event_type)),
k as (select event_type, bx, by_, count(*) as c from b group by 1, 2, 3),
m as (select *, sum(c) over (partition by event_type, bx) as cx, sum(c) over (partition by event_type, by_) as cy, sum(c) over (partition by event_type) as n from k),
i as (select event_type, round(sum(c / n * ln(c * n / (cx * cy))), 6) as mutual_information from m group by 1)
select event_type as feature_id, pearson, spearman, mutual_information, case when abs(pearson) < 0.05 and abs(spearman) < 0.05 and mutual_information < 0.01 then 'DROP' else 'KEEP' end as decision from c join i using (event_type)""")
def feature_audit_report(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("feature_id"), F.floor("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    out = feature_audit.report(rows, "x", "y", "feature_id")
    return feature_audit.recommend(out).select("feature_id", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), r6("mutual_information").alias("mutual_information"), "decision")


@query(f"with {HOURS} select source_id, hour, round(list_sort(vs)[2], 6) as low, round(list_sort(vs)[5], 6) as high from (select source_id, date_trunc('day', hour) as hour, list(value) as vs, from hours group by 1, 2) where len(vs) >= 5")
def nearest_interval(spark, d):
    from ..functions.scalars import nearest_interval as nearest

    rows = hours(spark, d).groupBy("source_id", F.date_trunc("day", "hour").cast("timestamp_ntz").alias("hour")).agg(F.collect_list("value").alias("vs")).where(F.size("vs") >= 5)
    low, high = nearest(F.col("vs"), 1, 4)
    return rows.select("source_id", "hour", r6(low).alias("low"), r6(high).alias("high"))


@query(f"with {TEV} select fold_id, target_name, count(*) as rows, count(distinct issue_time) as issues from sel group by 1, 2 having not (count(*) = 24 and count(distinct issue_time) = 1)")
def fixed_origin_check(spark, d):
    rows = champion_rows(spark, d).withColumn("horizon", F.hour("issue_time") + 1)
    return splits.check_weekly(rows, 24, "fold_id", "target_name").select("fold_id", "target_name", "rows", "issues")


@query()
def sampler_evaluation(spark, d):
    """Weekly scores of three samplers, each fitted on the folds before."""
    p = settled_panel(spark, d).withColumnRenamed("fold_id", "week")
    return uncertainty.evaluate_samplers(p, TARGETS, ["independent_gaussian", "correlated_gaussian", "empirical_bootstrap"], seed=20260910, samples=100)


@query()
def capture_curve(spark, d):
    p = settled_panel(spark, d)
    return uncertainty.capture_curve(p, TARGETS, [0.25, 1.0, 4.0], key="timestamp", seed=20260910, samples=100)


@query()
def calibrated_scales(spark, d):
    p = settled_panel(spark, d)
    return uncertainty.calibrate(p.where("fold_id < 3"), p.where("fold_id >= 3"), TARGETS, uncertainty.bucket("none"), key="timestamp", seed=20260910, samples=100)


@query()
def submission_rows(spark, d):
    """A submission in position order, drawn from the panel's residual pool."""
    p = settled_panel(spark, d)
    drawn = uncertainty.pool_samples(p, p, TARGETS, key="timestamp", seed=20260910)
    return scoring.submission_table(drawn, TARGETS, "timestamp", rows_expected=None)
