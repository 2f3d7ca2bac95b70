"""Fixture views standing in for the clinical table, media and predictions.

Each view is defined once here (DataFrame API) and once in
``tessera.plans.sqlviews`` (DuckDB SQL); the two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_key
from tessera.sources.tables import table

# The four target classes, in sorted (label-encoder) order.
CLASSES = ["Healthy", "Mild_Stress", "Moderate_Stress", "Severe_Stress"]

# Event type -> class (stands in for the emotion -> class map:
# happy Healthy; neutral, surprise Mild_Stress; angry, disgust Moderate_Stress;
# sad, fear Severe_Stress).
EVENT_CLASS_MAP = [
    ("signup", "Healthy"),
    ("view", "Mild_Stress"),
    ("click", "Mild_Stress"),
    ("purchase", "Moderate_Stress"),
    ("error", "Severe_Stress"),
]

TAB_FEATURES = ["f_acctbal", "f_n", "f_spend", "f_avg", "f_max"]


class Views:
    """Lazily built fixture views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    # clinical table with natural NULLs
    def v_tab(self) -> DataFrame:
        o = (self.t("orders")
             .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
             .groupBy("o_custkey")
             .agg(F.count(F.lit(1)).alias("f_n"),
                  F.round(F.sum("o_totalprice"), 6).alias("f_spend"),
                  F.round(F.avg("o_totalprice"), 6).alias("f_avg"),
                  F.max("o_totalprice").alias("f_max")))
        c = self.t("customer")
        return (c.join(o, c.c_custkey == o.o_custkey, "left")
                .select(F.col("c_custkey").alias("id"),
                        F.col("c_acctbal").alias("f_acctbal"),
                        F.coalesce(F.col("f_n"), F.lit(0)).cast("bigint").alias("f_n"),
                        "f_spend", "f_avg", "f_max",
                        F.col("c_mktsegment").alias("label")))

    def v_img(self) -> DataFrame:
        return self.t("embeddings").select(F.col("vec_id").alias("id"),
                                           F.col("embedding").alias("vec"), "label")

    def v_sig(self) -> DataFrame:
        e = self.t("events")
        return (e.groupBy("user_id")
                .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("pts"))
                .select(F.col("user_id").alias("id"),
                        F.transform("pts", lambda p: p["value"]).alias("sig")))

    def v_sig_head(self, n: int) -> DataFrame:
        """First ``n`` points of each v_sig signal.  The row_number filter is
        applied per partition before the shuffle (WindowGroupLimit), so a
        user with a huge history never gathers in one task."""
        e = self.t("events")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        h = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
        return (h.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_rn", "value"))).alias("pts"))
                .select(F.col("user_id").alias("id"), F.transform("pts", lambda p: p["value"]).alias("sig")))

    def v_cls(self) -> DataFrame:
        d = self.t("documents")
        lab = self.t("labels")

        def count_of(ch: str):
            return F.length("text") - F.length(F.replace(F.col("text"), F.lit(ch), F.lit("")))

        spaces = (count_of(" ") + 1).cast("double")
        lines = (count_of("\n") + 1).cast("double")
        label = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Healthy")
                 .when((F.col("quality") == 1) & (F.col("toxic") == 1), "Mild_Stress")
                 .when((F.col("quality") == 0) & (F.col("toxic") == 0), "Moderate_Stress")
                 .otherwise("Severe_Stress"))
        return (lab.join(d, "doc_id")
                .select(F.col("doc_id").alias("id"),
                        F.array(F.col("n_chars").cast("double"), spaces, lines,
                                F.col("n_chars").cast("double") / spaces).alias("vec"),
                        label.alias("label")))

    def v_pred(self) -> DataFrame:
        c = self.v_cls()
        n = c["vec"][0]
        y_pred = (F.when(n < 100, "Severe_Stress").when(n < 500, "Moderate_Stress")
                  .when(n < 1000, "Mild_Stress").otherwise("Healthy"))
        raw = [(F.lit(1) + hash_key(F.col("id"), str(k)) % 100).cast("double") for k in range(4)]
        total = raw[0] + raw[1] + raw[2] + raw[3]
        return c.select("id", F.col("label").alias("y_true"),
                        y_pred.alias("y_pred"),
                        F.when(y_pred == "Mild_Stress", "Healthy").otherwise(y_pred).alias("y_pred_b"),
                        F.array(*[r / total for r in raw]).alias("scores"))

    def v_pred_long(self) -> DataFrame:
        """Both prediction variants stacked as two 'models'."""
        p = self.v_pred()
        return p.select("id", "y_true", F.expr(
            "stack(2, 'rule_a', y_pred, 'rule_b', y_pred_b) as (model, y_pred)"), "scores")

    def v_emap(self) -> DataFrame:
        return self.spark.createDataFrame(EVENT_CLASS_MAP, "event_type string, label string")

    def v_req(self, keep=()) -> DataFrame:
        """Scoring requests; ``keep`` passes event columns through."""
        # parse props once, derive the request fields from the parsed value
        e = self.t("events").select("event_id", "value", *keep,
                                    F.get_json_object("props", "$.k").cast("int").alias("_k"))
        k = F.col("_k")
        return e.select(*keep,
            F.col("event_id").alias("id"),
            F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(
                F.concat(F.lit("a/"), F.col("event_id").cast("string"))).alias("audio_path"),
            F.when(F.col("event_id") % 19 == 0, F.lit(None).cast("string")).otherwise(
                F.concat(F.lit("i/"), F.col("event_id").cast("string"))).alias("image_path"),
            F.nullif(k % 60, F.lit(13)).cast("double").alias("depression"),
            (F.floor("value") % 60).cast("double").alias("anxiety"),
            ((k * 7) % 55).cast("double").alias("stress"),
            (k % 12).cast("double").alias("sleep"))

    def v_epoch(self) -> DataFrame:
        days = (self.t("events").groupBy(F.to_date("ts").alias("day"))
                .agg(F.round(F.avg("value"), 6).alias("acc")))
        # 30 rows (one per day): an unpartitioned window over the tiny daily table.
        return days.select(F.row_number().over(Window.orderBy("day")).cast("int").alias("epoch"),
                           "acc")
