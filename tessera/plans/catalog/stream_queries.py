"""Streaming request scoring (equal to the batch scorer)."""

from __future__ import annotations

from tessera.functions.hashing import sql_hash
from tessera.operators import score as sc
from tessera.plans import request_media as rm
from tessera.plans.catalog.registry import query
from tessera.plans.catalog.score_queries import SCORE_CTES, request_state
from tessera.plans.views import CLASSES, Views
from tessera.session import scratch_path
from tessera.streaming.intake import read_answers
from tessera.streaming.scoring import read_scored, score_stream


@query("stream_score", f"WITH {SCORE_CTES} SELECT id, result, pred_label FROM scored")
def q_stream_score(spark, sf):
    req = Views(spark, sf).v_req()
    inbox = scratch_path(spark, "requests")
    # the arriving requests: several files, as a request log would land
    req.repartition(4, "id").write.mode("overwrite").parquet(inbox)
    scaler = sc.load_request_state(spark, request_state(spark, sf))
    out = score_stream(spark, inbox, req.schema, scaler, max_files_per_trigger=2)
    return read_scored(spark, out)


_MEDIA_CTES = f"""{SCORE_CTES.split(",\n  prm AS")[0]},
  au AS (SELECT event_id AS id, [a, b, c] AS aud FROM events JOIN (SELECT user_id, avg(value) AS a, min(value) AS b, max(value) AS c
         FROM events GROUP BY user_id) USING (user_id) WHERE event_id % {rm.LOST} <> 0),
  im AS (SELECT event_id AS id, vec, event_id % {rm.BROKEN} <> 0 AS ok FROM events JOIN v_img ON v_img.id = event_id % (SELECT count(*) FROM embeddings)),
  jn AS (SELECT chk.*, aud, vec, CASE WHEN err IS NOT NULL THEN err WHEN aud IS NULL THEN 'Inference Error: no audio at ' || audio_path
           WHEN vec IS NULL THEN 'Inference Error: no image at ' || image_path WHEN NOT ok THEN 'Inference Error: cannot decode ' || image_path END AS why
         FROM chk LEFT JOIN au USING (id) LEFT JOIN im USING (id)),
  cells AS (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS j
            FROM (SELECT id, [{", ".join(sc.REQUEST_FEATURES)}] || aud || vec::DOUBLE[] AS x FROM jn WHERE why IS NULL)),
  st AS (SELECT j, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1.0) AS scale FROM cells WHERE {sql_hash("id", "'history'")} % 2 = 0 GROUP BY j),
  lg AS (SELECT id, c, round(sum((x - mean) / scale * (((31 * c + 17 * j + 7 * c * j) % 23 - 11) / 10.0)), 6) AS score
         FROM cells JOIN st USING (j), range({len(CLASSES)}) r(c) GROUP BY id, c),
  best AS (SELECT id, [{", ".join(f"'{c}'" for c in CLASSES)}][list_position(list(score ORDER BY c), max(score))] AS pred_label FROM lg GROUP BY id)"""


@query("stream_media_accepted", f"WITH {_MEDIA_CTES} SELECT id, pred_label, '{sc.RESULT_PREFIX}' || pred_label AS result FROM best")
def q_stream_media_accepted(spark, sf):
    """The answers of the streamed requests whose fields and media are in order."""
    return read_answers(spark, rm.streamed(spark, sf))[0]


@query("stream_media_rejected", f"WITH {_MEDIA_CTES} SELECT id, why AS reason FROM jn WHERE why IS NOT NULL")
def q_stream_media_rejected(spark, sf):
    """The reject table: fields out of range, media missing, lost or broken."""
    return read_answers(spark, rm.streamed(spark, sf))[1]
