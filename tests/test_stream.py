"""Stream scoring survives restarts: the checkpointed sink neither drops
nor duplicates requests."""

from pyspark.sql import functions as F

from tessera.operators import score as sc
from tessera.plans.views import Views
from tessera.session import scratch_path
from tessera.streaming.scoring import read_scored, score_stream
from tests.conftest import SF_SMALL


def test_restart_is_exactly_once(spark):
    req = Views(spark, SF_SMALL).v_req()
    scaler = sc.fit_request_scaler(sc.validated(req).where(F.col("err").isNull()))
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("inbox", "out", "ckpt"))
    first = req.where(F.col("id") % 2 == 0)
    second = req.where(F.col("id") % 2 == 1)
    first.write.mode("append").parquet(inbox)
    score_stream(spark, inbox, req.schema, scaler, out, ckpt)
    n1 = read_scored(spark, out).count()
    assert n1 == first.count()
    # restart with nothing new: no duplicates
    score_stream(spark, inbox, req.schema, scaler, out, ckpt)
    assert read_scored(spark, out).count() == n1
    # new files arrive: only they are scored
    second.write.mode("append").parquet(inbox)
    score_stream(spark, inbox, req.schema, scaler, out, ckpt)
    got = read_scored(spark, out)
    assert got.count() == req.count()
    assert got.select("id").distinct().count() == req.count()
    batch = sc.score_requests(req, scaler)
    assert got.exceptAll(batch).count() == 0


def test_one_request_alone_equals_the_batch(spark):
    req = Views(spark, SF_SMALL).v_req()
    state = sc.save_request_state(req.where(F.col("id") % 2 == 0), scratch_path(spark, "state"))
    batch = {r.id: (r.result, r.pred_label) for r in sc.score_batch(req, state).collect()}
    for i in (3, 17, 101, 250):
        one = sc.score_batch(req.where(F.col("id") == i), state).collect()
        assert [(r.id, (r.result, r.pred_label)) for r in one] == [(i, batch[i])]
