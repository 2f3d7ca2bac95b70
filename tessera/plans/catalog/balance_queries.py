"""kNN within class and SMOTE over v_img / v_cls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions.hashing import sql_hash
from tessera.operators import balance as bl
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import r6 as R6
from tessera.plans.views import Views

_D2 = "list_reduce(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x, y: x + y)"


def _knn_sql(src):
    return f"""pts AS (SELECT id, CAST(vec AS DOUBLE[]) AS v, label FROM {src}),
  nn AS (SELECT a.id, b.id AS nbr_id, b.v AS nbr_v, {_D2} AS dist2,
                row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS nbr_rank
         FROM pts a JOIN pts b ON a.label = b.label AND a.id <> b.id)"""


@query("knn_within_class", f"""WITH {_knn_sql('v_img')}
  SELECT id, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_id, {r6('sqrt(dist2)')} AS dist FROM nn WHERE nbr_rank <= 5""")
def q_knn_within_class(spark, sf):
    v = Views(spark, sf).v_img()
    nn = bl.knn_within_class(v, "id", "vec", "label", 5)
    return nn.select("id", "nbr_rank", "nbr_id", R6(F.sqrt("dist2")).alias("dist"))


_SMOTE_SQL = f"""WITH {_knn_sql('v_cls')},
  r AS (SELECT id, label, CAST(vec AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS rk,
               count(*) OVER (PARTITION BY label) AS nc FROM v_cls),
  cls AS (SELECT DISTINCT label, nc, least(5, nc - 1) AS kc, max(nc) OVER () - nc AS d FROM r),
  syn0 AS (SELECT label, nc, kc, unnest(range(1, d + 1)) AS s FROM cls WHERE d > 0),
  syn1 AS (SELECT *, {sql_hash("label || '|' || CAST(s AS VARCHAR)", "'pick'")} %
                      (CASE WHEN kc > 0 THEN nc * kc ELSE nc END) AS i,
                  CAST({sql_hash("label || '|' || CAST(s AS VARCHAR)", "'gap'")} AS DOUBLE) / 4294967296.0 AS u
           FROM syn0),
  syn2 AS (SELECT *, CASE WHEN kc > 0 THEN i // kc ELSE i END AS brk,
                     CASE WHEN kc > 0 THEN i % kc + 1 ELSE 0 END AS nr FROM syn1),
  syn AS (SELECT syn2.label, syn2.s, r.id AS base_id, coalesce(nn.nbr_id, r.id) AS nbr_id,
                 list_transform(list_zip(r.v, coalesce(nn.nbr_v, r.v)), lambda t: t[1] + syn2.u * (t[2] - t[1])) AS v
          FROM syn2 JOIN r ON r.label = syn2.label AND r.rk = syn2.brk
          LEFT JOIN nn ON nn.id = r.id AND nn.nbr_rank = syn2.nr)"""


@query("smote", _SMOTE_SQL + f"""
  SELECT label, 'orig' AS src, id AS seq, CAST(NULL AS BIGINT) AS base_id, CAST(NULL AS BIGINT) AS nbr_id,
         list_transform(v, lambda x: round(x, 6) + 0.0) AS vec FROM r
  UNION ALL
  SELECT label, 'synth', s, base_id, nbr_id, list_transform(v, lambda x: round(x, 6) + 0.0) FROM syn""")
def q_smote(spark, sf):
    out = bl.smote(Views(spark, sf).v_cls(), "id", "vec", "label", 5)
    return out.withColumn("vec", ar.round_array(F.col("vec")))


@query("resample_counts", """SELECT label, count(*) AS n_before, max(count(*)) OVER () AS n_after
    FROM v_cls GROUP BY label""")
def q_resample_counts(spark, sf):
    v = Views(spark, sf).v_cls()
    before = v.groupBy("label").agg(F.count(F.lit(1)).alias("n_before"))
    after = bl.smote(v, "id", "vec", "label", 5).groupBy("label").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "label")
