"""Requests with media: late and lost media, restarts, stream = batch, decoded files."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.operators import media as me, stages as st
from tessera.operators.score import MISSING_INPUT_MSG
from tessera.plans.media_files import BAD_BYTES, png_bytes, wav_bytes, write_bytes
from tessera.session import scratch_path
from tessera.streaming import intake

REQ = "id long, audio_path string, image_path string, depression double, anxiety double, stress double, sleep double"


def pipeline(spark, width):
    path = scratch_path(spark, "pipe")
    weights = [((7 * c + 3 * j) % 5 - 2) / 10 for c in range(4) for j in range(width)]
    PipelineModel([st.LinearScorer(inputCol="vec", weights=weights, biases=[0.0, 0.1, 0.2, 0.3]),
                   st.PredictionDecoderModel(inputCol="prediction", outputCol="pred_label", labels=["a", "b", "c", "d"])]).write().save(path)
    return path


@pytest.fixture()
def world(spark):
    root = scratch_path(spark, "intake-test")
    media = spark.createDataFrame([(f"{k}{i}", [float(i), 1.0], True) for i in range(8) for k in "ai" if (k, i) != ("a", 3)] + [("i5", [0.0, 0.0], False)]
                                  + [("a6", [9.0, 9.0], False)], intake.MEDIA_SCHEMA).where("path not in ('i5') or not decode_ok")
    media.where("path != 'i2'").write.parquet(f"{root}/media/drop=0")
    rows = [(i, f"a{i}", f"i{i}", 10.0, None, 20.0, 5.0) for i in range(8)] + [(100, "", "i1", 1.0, 1.0, 1.0, 1.0), (101, "a1", "i1", 99.0, 1.0, 1.0, 1.0)]
    req = spark.createDataFrame(rows, REQ)
    return spark, root, media, req, pipeline(spark, 9)


def run(world, **kw):
    spark, root, _, req, pipe = world
    intake.answer_stream(spark, f"{root}/requests", req.schema, pipe, f"{root}/media", f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1, **kw)


def test_late_lost_broken_and_restart(world):
    spark, root, media, req, pipe = world
    for n in range(2):
        req.where(F.col("id") % 2 == n).coalesce(1).write.mode("append").parquet(f"{root}/requests")
    run(world)
    waiting = {r.id for r in spark.read.parquet(f"{root}/out/waiting/batch=1").collect()}
    assert waiting == {2, 3}                            # late image, lost audio
    media.where("path = 'i2'").write.parquet(f"{root}/media/drop=1")

    class Stop(Exception):
        pass

    real, calls = intake.answers, []

    def failing(*a):
        calls.append(1)
        raise Stop("lost between the waiting folder and the answers")
    req.where("id = 4").withColumn("id", F.lit(400).cast("long")).coalesce(1).write.mode("append").parquet(f"{root}/requests")
    intake.answers = failing
    with pytest.raises(Exception):
        run(world)
    intake.answers = real
    assert calls
    run(world)                                          # the batch runs again, the earlier ones do not
    run(world)
    intake.settle(spark, req.schema, pipe, f"{root}/media", f"{root}/out", last=2)
    accepted, rejected = intake.read_answers(spark, f"{root}/out")
    ok, bad = sorted(r.id for r in accepted.collect()), {r.id: r.reason for r in rejected.collect()}
    assert ok == [0, 1, 2, 4, 6, 7, 400] and accepted.count() + rejected.count() == 11
    assert bad == {3: "Inference Error: no audio at a3", 5: "Inference Error: cannot decode i5", 100: MISSING_INPUT_MSG,
                   101: "Inference Error: depression out of range [0, 50]"}
    batch = intake.with_media(req.withColumn("asked", F.lit(0)), media)
    want = {r.id: (r.pred_label, r.result) for r in intake.answers(batch.where(intake.complaint().isNull()), PipelineModel.load(pipe)).collect()}
    assert {r.id: (r.pred_label, r.result) for r in accepted.where("id < 400").collect()} == want


def test_decoded_files(spark):
    """Features decoded from WAV and PNG files answer requests that name the files."""
    root = scratch_path(spark, "files").replace("file:", "")
    tone = np.sin(np.arange(4000) / 8)
    for i in range(3):
        write_bytes(f"{root}/a{i}.wav", BAD_BYTES if i == 2 else wav_bytes(tone * (i + 1) / 3, 8000))
        write_bytes(f"{root}/i{i}.png", png_bytes(np.full((40, 40), 40 * i, np.uint8)))
    media = (me.audio_features(me.read_audio(spark, root)).select("path", "features", "decode_ok")
             .unionByName(me.image_features(me.read_images(spark, root)).select("path", "features", "decode_ok")))
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in media.select("path").collect()}
    assert len(paths) == 6
    req = spark.createDataFrame([(i, paths[f"a{i}.wav"], paths[f"i{i}.png"], 1.0, 2.0, 3.0, 4.0) for i in range(3)], REQ)
    joined = intake.with_media(req, media)
    assert {r.id: r.why for r in joined.select("id", intake.complaint().alias("why")).collect()} == {0: None, 1: None, 2: f"Inference Error: cannot decode {paths['a2.wav']}"}
    got = intake.answers(joined.where(intake.complaint().isNull()), PipelineModel.load(pipeline(spark, 5 + 13 + 1024))).collect()
    assert sorted(r.id for r in got) == [0, 1] and all(r.result.endswith(r.pred_label) for r in got)


def test_media_table_is_joined_in_place(world):
    """Features are shuffled when they are delivered, not by every batch; a later delivery is seen."""
    spark, root, media, req, _ = world
    name = "media_in_place_test"
    intake.deliver(media.where("path != 'i2'"), name, f"{root}/table", 8)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = req.withColumn("asked", F.lit(0))
        got = intake.with_media(todo, intake.read_media(spark, f"{intake.TABLE}{name}"))
        rows = {r.id: r.why for r in got.select("id", intake.complaint().alias("why")).collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "features" in x and "audio_path" not in x]
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(path" in x]
        scans = plan.split("== Initial Plan ==")[0].count("Bucketed: true")
        assert scans == 2 and len(moved) <= 4                          # the requests' paths, in both plans
        assert rows[2] == "Inference Error: no image at i2"
        intake.deliver(media.where("path = 'i2'"), name, f"{root}/table", 8)
        got = intake.with_media(todo, intake.read_media(spark, f"{intake.TABLE}{name}"))
        old = intake.with_media(todo, media)
        assert sorted(map(str, got.select("id", "audio", "image").collect())) == sorted(map(str, old.select("id", "audio", "image").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql(f"DROP TABLE {name}")
