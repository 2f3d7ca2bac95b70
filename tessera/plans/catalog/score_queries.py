"""Request scoring (batch), predicted-class distributions and report text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.hashing import hash_key, sql_hash
from tessera.operators import score as sc
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import r6 as R6
from tessera.plans.views import CLASSES, Views
from tessera.session import scratch_path


def _range_sql():
    parts = [f"WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN 'Inference Error: {c} out of range [{lo:g}, {hi:g}]'"
             for c, (lo, hi) in sc.REQUEST_RANGES.items()]
    return "CASE " + " ".join(parts) + " END"


def _logit_sql(z):
    out = []
    for w, b in zip(sc.LINEAR_WEIGHTS, sc.LINEAR_BIAS):
        e = f"{b!r}"
        for j, zz in enumerate(z):
            e = f"({e} + {w[j]!r} * {zz})"
        out.append(e)
    return "[" + ", ".join(out) + "]"


_F = sc.REQUEST_FEATURES
_classes_sql = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
SCORE_CTES = f"""req AS (SELECT id, audio_path, image_path, """ + ", ".join(
    f"coalesce({c}, {v!r}) AS {c}" for c, v in sc.REQUEST_DEFAULTS.items()) + f""" FROM v_req),
  chk AS (SELECT *, 70 + anxiety * 0.8 AS heart_rate_bpm,
            CASE WHEN audio_path IS NULL OR audio_path = '' OR image_path IS NULL OR image_path = ''
                 THEN '{sc.MISSING_INPUT_MSG}' ELSE {_range_sql()} END AS err FROM req),
  prm AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in _F) + f""" FROM chk WHERE err IS NULL AND {sql_hash('id', "'history'")} % 2 = 0),
  zz AS (SELECT id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 9) AS z_{c}" for c in _F) + f""" FROM chk, prm WHERE err IS NULL),
  pr AS (SELECT id, {_classes_sql}[list_position(lg, list_max(lg))] AS pred_label
         FROM (SELECT id, {_logit_sql([f'z_{c}' for c in _F])} AS lg FROM zz) l),
  scored AS (SELECT chk.id, coalesce(chk.err, '{sc.RESULT_PREFIX}' || pr.pred_label) AS result,
                    CASE WHEN chk.err IS NULL THEN pr.pred_label END AS pred_label
             FROM chk LEFT JOIN pr USING (id))"""


@query("override_defaults", "SELECT id, " + ", ".join(
    f"coalesce({c}, {v!r}) AS {c}" for c, v in sc.REQUEST_DEFAULTS.items()) + " FROM v_req")
def q_override_defaults(spark, sf):
    return sc.override_defaults(Views(spark, sf).v_req()).select("id", *sc.REQUEST_DEFAULTS)


@query("derive_linear", f"SELECT id, {r6('70 + anxiety * 0.8')} AS heart_rate_bpm FROM v_req")
def q_derive_linear(spark, sf):
    return sc.derive_heart_rate(Views(spark, sf).v_req()).select("id", R6(F.col("heart_rate_bpm")).alias("heart_rate_bpm"))


@query("require_inputs", f"""SELECT id, NOT (audio_path IS NULL OR audio_path = '' OR image_path IS NULL OR image_path = '')
    AS inputs_ok, CASE WHEN audio_path IS NULL OR audio_path = '' OR image_path IS NULL OR image_path = ''
    THEN '{sc.MISSING_INPUT_MSG}' END AS input_error FROM v_req""")
def q_require_inputs(spark, sf):
    return sc.require_inputs(Views(spark, sf).v_req()).select("id", "inputs_ok", "input_error")


@query("range_validate", f"""SELECT id, {_range_sql()} IS NULL AS valid, {_range_sql()} AS reason
    FROM (SELECT id, """ + ", ".join(f"coalesce({c}, {v!r}) AS {c}" for c, v in sc.REQUEST_DEFAULTS.items())
       + " FROM v_req) r")
def q_range_validate(spark, sf):
    r = sc.override_defaults(Views(spark, sf).v_req())
    e = sc.range_errors()
    return r.select("id", e.isNull().alias("valid"), e.alias("reason"))


def request_state(spark, sf) -> str:
    """Stored state, fitted on the half of the requests that count as history."""
    history = Views(spark, sf).v_req().where(hash_key(F.col("id"), "history") % 2 == 0)
    return sc.save_request_state(history, scratch_path(spark, "request-state"))


@query("score_linear", f"WITH {SCORE_CTES} SELECT id, result, pred_label FROM scored")
def q_score_linear(spark, sf):
    return sc.score_batch(Views(spark, sf).v_req(), request_state(spark, sf))


def _scored_events(spark, sf):
    """Scored requests beside their event type (the 'true folder')."""
    v = Views(spark, sf)
    return sc.score_batch(v.v_req(keep=("event_type",)), request_state(spark, sf), keep=("event_type",)).where(F.col("pred_label").isNotNull())


_DIST_CTES = f"""WITH {SCORE_CTES},
  se AS (SELECT s.id, e.event_type, s.pred_label FROM scored s JOIN events e ON s.id = e.event_id
         WHERE s.pred_label IS NOT NULL),
  cnt AS (SELECT event_type, pred_label, count(*) AS n FROM se GROUP BY event_type, pred_label),
  sh AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total,
                CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY event_type) * 100 AS share FROM cnt)"""


def _shares(spark, sf):
    c = _scored_events(spark, sf).groupBy("event_type", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")
    return (c.withColumn("total", F.sum("n").over(w))
             .withColumn("share", F.col("n").cast("double") / F.col("total") * 100))


@query("share_of_group", _DIST_CTES + f" SELECT event_type, pred_label, n, CAST(total AS BIGINT) AS total, {r6('share')} AS share FROM sh")
def q_share_of_group(spark, sf):
    return _shares(spark, sf).select("event_type", "pred_label", "n", F.col("total").cast("bigint"),
                                     R6(F.col("share")).alias("share"))


def _cap_sql(x):
    return f"upper(left({x}, 1)) || lower(substr({x}, 2))"


@query("prediction_distribution", _DIST_CTES + f"""
  SELECT rpad({_cap_sql('event_type')}, CAST(greatest(12, length({_cap_sql('event_type')})) AS INTEGER), ' ') AS emotion,
         CAST(max(total) AS BIGINT) AS total,
         string_agg(pred_label || ': ' || printf('%.1f', share) || '%', ', ' ORDER BY n DESC, pred_label) AS distribution
  FROM sh GROUP BY event_type""")
def q_prediction_distribution(spark, sf):
    s = _shares(spark, sf)
    item = F.concat(F.col("pred_label"), F.lit(": "), tx.format_percent(F.col("share"), 1))
    # per group only #classes rows: sort the (count, label, text) structs and join
    srt = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("pred_label").alias("l"), item.alias("t"))))
    return s.groupBy("event_type").agg(F.max("total").cast("bigint").alias("total"), srt.alias("items")).select(
        tx.pad_text(tx.capitalize(F.col("event_type")), 12).alias("emotion"), "total",
        F.array_join(F.transform("items", lambda x: x["t"]), ", ").alias("distribution"))


@query("skip_empty_groups", _DIST_CTES + " SELECT event_type, pred_label, n FROM cnt WHERE n > 0")
def q_skip_empty_groups(spark, sf):
    c = _scored_events(spark, sf).groupBy("event_type", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    return c.where(F.col("n") > 0)


@query("capitalize", f"SELECT DISTINCT event_type, {_cap_sql('event_type')} AS label_text FROM events")
def q_capitalize(spark, sf):
    e = Views(spark, sf).t("events").select("event_type").distinct()
    return e.select("event_type", tx.capitalize(F.col("event_type")).alias("label_text"))


@query("pad_text", f"""SELECT DISTINCT event_type, rpad({_cap_sql('event_type')},
    CAST(greatest(12, length({_cap_sql('event_type')})) AS INTEGER), ' ') AS padded FROM events""")
def q_pad_text(spark, sf):
    e = Views(spark, sf).t("events").select("event_type").distinct()
    return e.select("event_type", tx.pad_text(tx.capitalize(F.col("event_type")), 12).alias("padded"))


@query("format_percent", _DIST_CTES + " SELECT event_type, pred_label, printf('%.1f', share) || '%' AS share_text FROM sh")
def q_format_percent(spark, sf):
    s = _shares(spark, sf)
    return s.select("event_type", "pred_label", tx.format_percent(F.col("share"), 1).alias("share_text"))
