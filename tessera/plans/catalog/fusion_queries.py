"""Ordinals, positional alignment, fused vectors and array/grid functions
over v_tab x v_img x v_sig; running best over v_epoch; path sorts over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions.hashing import hash_key, sql_hash
from tessera.operators import fusion as fu, prep, profile as pf
from tessera.operators.ordinal import rank_within, running_before
from tessera.operators.signal import signal_mfcc
from tessera.plans.catalog.registry import query
from tessera.plans.views import TAB_FEATURES as TF, Views
from tessera.session import materialize

AUDIO_WIDTH = 13


def _rl(x):
    return f"list_transform({x}, lambda v: round(v, 6) + 0.0)"


_ALIGN_CTES = """ta AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, * FROM v_tab),
  ia AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, id AS img_id, vec, label AS img_label FROM v_img),
  sa AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, id AS sig_id, sig FROM v_sig),
  al AS (SELECT ta.ordinal, ta.id AS tab_id, ta.label AS tab_label, """ + ", ".join(f"ta.{c}" for c in TF) + """,
                ia.img_id, ia.img_label, ia.vec, sa.sig_id, sa.sig
         FROM ta JOIN ia USING (ordinal) JOIN sa USING (ordinal))"""
_TAB_ARR_SQL = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in TF) + "]"


def aligned(spark, sf):
    """v_tab x v_img x (first AUDIO_WIDTH points of) v_sig by position."""
    v = Views(spark, sf)
    return fu.align_by_position({"tab": (v.v_tab(), ["id"]), "img": (v.v_img(), ["id"]),
                                 "sig": (v.v_sig_head(AUDIO_WIDTH), ["id"])})


def aligned_ids(spark, sf):
    """v_tab x v_img x the ids of v_sig by position: for what does not read the signals."""
    v = Views(spark, sf)
    return fu.align_by_position({"tab": (v.v_tab(), ["id"]), "img": (v.v_img(), ["id"]),
                                 "sig": (v.t("events").select(F.col("user_id").alias("id")).distinct(), ["id"])})


def aligned_mfcc(spark, sf):
    """v_tab x v_img x (AUDIO_WIDTH MFCC means of the whole of) v_sig by position."""
    v = Views(spark, sf)
    audio = signal_mfcc(v.t("events"), "user_id", ["ts", "event_id"], "value", n_mfcc=AUDIO_WIDTH)
    return fu.align_by_position({"tab": (v.v_tab(), ["id"]), "img": (v.v_img(), ["id"]),
                                 "sig": (materialize(audio.withColumnRenamed("user_id", "id")), ["id"])})


def _tab_arr():
    return F.array(*[F.col(f"tab_{c}").cast("double") for c in TF])


@query("row_ordinal", """SELECT 'tab' AS source, id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM v_tab
    UNION ALL SELECT 'img', id, row_number() OVER (ORDER BY id) - 1 FROM v_img
    UNION ALL SELECT 'sig', id, row_number() OVER (ORDER BY id) - 1 FROM v_sig""")
def q_row_ordinal(spark, sf):
    v = Views(spark, sf)
    parts = [fu.with_ordinal(df.select("id"), ["id"]).select(F.lit(n).alias("source"), "id", "ordinal")
             for n, df in [("tab", v.v_tab()), ("img", v.v_img()), ("sig", v.v_sig())]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("align_by_position", f"WITH {_ALIGN_CTES} SELECT ordinal, tab_id, tab_label, img_id, img_label, sig_id FROM al")
def q_align_by_position(spark, sf):
    return aligned_ids(spark, sf).select("ordinal", "tab_id", "tab_label", "img_id", "img_label", "sig_id")


@query("head_n", """SELECT id, ordinal FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM v_tab) t
    WHERE ordinal < least((SELECT count(*) FROM v_tab), (SELECT count(*) FROM v_img), (SELECT count(*) FROM v_sig))""")
def q_head_n(spark, sf):
    v = Views(spark, sf)
    n = min(v.v_tab().count(), v.v_img().count(), v.v_sig().count())
    return fu.head_n(v.v_tab().select("id"), ["id"], n)


@query("concat_vectors", f"""WITH {_ALIGN_CTES}
    SELECT ordinal, {_rl(f"{_TAB_ARR_SQL} || sig[1:{AUDIO_WIDTH}] || CAST(vec AS DOUBLE[])")} AS fused FROM al""")
def q_concat_vectors(spark, sf):
    a = aligned(spark, sf)
    fused = F.concat(_tab_arr(), F.slice("sig_sig", 1, AUDIO_WIDTH), ar.to_double(F.col("img_vec")))
    return a.select("ordinal", ar.round_array(fused).alias("fused"))


_ZEROS_SQL = "[" + ", ".join(["0.0"] * AUDIO_WIDTH) + "]"


@query("zero_fill_modality", f"""WITH {_ALIGN_CTES}
    SELECT ordinal, {_rl(f"{_TAB_ARR_SQL} || {_ZEROS_SQL} || CAST(vec AS DOUBLE[])")} AS fused FROM al""")
def q_zero_fill_modality(spark, sf):
    a = aligned_ids(spark, sf)
    fused = F.concat(_tab_arr(), ar.zeros(AUDIO_WIDTH), ar.to_double(F.col("img_vec")))
    return a.select("ordinal", ar.round_array(fused).alias("fused"))


@query("broadcast_defaults", "SELECT i.id, " + _rl(
    "[" + ", ".join(f"m_{c}" for c in TF) + f"] || {_ZEROS_SQL} || CAST(i.vec AS DOUBLE[])")
    + " AS fused FROM v_img i, (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in TF) + " FROM v_tab) m")
def q_broadcast_defaults(spark, sf):
    v = Views(spark, sf)
    med = prep.params_dict(pf.column_medians(v.v_tab(), TF), "feature", "median")
    defaults = F.array(*[F.lit(float(med[c])) for c in TF])   # one small row, inlined
    fused = F.concat(defaults, ar.zeros(AUDIO_WIDTH), ar.to_double(F.col("vec")))
    return v.v_img().select("id", ar.round_array(fused).alias("fused"))


@query("shape_report", f"""WITH {_ALIGN_CTES}
    SELECT 'tab' AS stage, count(*) AS n_rows, {len(TF)} AS n_cols FROM v_tab
    UNION ALL SELECT 'img', count(*), CAST(max(len(vec)) AS INTEGER) FROM v_img
    UNION ALL SELECT 'audio', count(*), {AUDIO_WIDTH} FROM v_sig
    UNION ALL SELECT 'fused', count(*), CAST(max(len(vec)) AS INTEGER) + {len(TF) + AUDIO_WIDTH} FROM al""")
def q_shape_report(spark, sf):
    v = Views(spark, sf)
    parts = [
        v.v_tab().agg(F.lit("tab").alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(TF)).alias("n_cols")),
        v.v_img().agg(F.lit("img").alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                      F.max(F.size("vec")).cast("int").alias("n_cols")),
        v.v_sig().agg(F.lit("audio").alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.lit(AUDIO_WIDTH).alias("n_cols")),
        aligned_ids(spark, sf).agg(F.lit("fused").alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                               (F.max(F.size("img_vec")) + len(TF) + AUDIO_WIDTH).cast("int").alias("n_cols")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("array_to_columns", "SELECT id, " + ", ".join(f"vec[{i + 1}] AS img_pixel_{i}" for i in range(64)) + " FROM v_img")
def q_array_to_columns(spark, sf):
    v = Views(spark, sf).v_img()
    return ar.array_to_columns(v.select("id", "vec"), "vec", "img_pixel_")


@query("slice_modalities", "SELECT id, vec[1:21] AS tab, vec[22:34] AS aud, vec[35:] AS img FROM v_img")
def q_slice_modalities(spark, sf):
    t, a, i = ar.slice_modalities(F.col("vec"), [21, 13, None])
    return Views(spark, sf).v_img().select("id", t.alias("tab"), a.alias("aud"), i.alias("img"))


@query("reshape_grid", "SELECT id, list_transform(range(8), lambda r: vec[r * 8 + 1:r * 8 + 8]) AS grid FROM v_img")
def q_reshape_grid(spark, sf):
    return Views(spark, sf).v_img().select("id", ar.reshape_grid(F.col("vec"), 8, 8).alias("grid"))


@query("flatten_grid", "SELECT id, flatten(list_transform(range(8), lambda r: vec[r * 8 + 1:r * 8 + 8])) AS flat FROM v_img")
def q_flatten_grid(spark, sf):
    g = Views(spark, sf).v_img().select("id", ar.reshape_grid(F.col("vec"), 8, 8).alias("grid"))
    return g.select("id", ar.flatten_grid(F.col("grid")).alias("flat"))


def _pool_sql():
    cells = []
    for k in range(16):
        r0, c0 = (k // 4) * 2, (k % 4) * 2
        idx = [(r0 + dr) * 8 + c0 + dc + 1 for dr in range(2) for dc in range(2)]
        s = f"CAST(vec[{idx[0]}] AS DOUBLE)"
        for j in idx[1:]:
            s = f"({s} + CAST(vec[{j}] AS DOUBLE))"
        cells.append(f"{s} / 4.0")
    return _rl("[" + ", ".join(cells) + "]")


@query("pool_grid", f"SELECT id, {_pool_sql()} AS pooled FROM v_img")
def q_pool_grid(spark, sf):
    return Views(spark, sf).v_img().select("id", ar.round_array(ar.pool_grid(F.col("vec"), 8, 8, 2)).alias("pooled"))


def _gray_sql():
    # the three planes of an image whose channels are the grid, its mirror and its negative
    px = [f"(((299.0 * CAST(vec[{i + 1}] AS DOUBLE)) + (587.0 * CAST(vec[{i // 8 * 8 + 8 - i % 8}] AS DOUBLE))) + "
          f"(114.0 * (0.0 - CAST(vec[{i + 1}] AS DOUBLE)))) / 1000.0" for i in range(64)]
    return _rl("[" + ", ".join(px) + "]")


@query("grayscale", f"SELECT id, {_gray_sql()} AS gray FROM v_img")
def q_grayscale(spark, sf):
    vec = ar.to_double(F.col("vec"))
    rgb = F.concat(vec, ar.flip_rows(vec, 8, 8), F.transform(vec, lambda x: F.lit(0.0) - x))
    return Views(spark, sf).v_img().select("id", rgb.alias("rgb")).select("id", ar.round_array(ar.grayscale(F.col("rgb"), 64)).alias("gray"))


@query("replicate_channels", "SELECT id, vec || vec || vec AS rgb FROM v_img")
def q_replicate_channels(spark, sf):
    return Views(spark, sf).v_img().select("id", ar.replicate_channels(F.col("vec")).alias("rgb"))


def _norm_sql():
    m, s = ar.CHANNEL_MEAN, ar.CHANNEL_STD
    parts = [f"list_transform(CAST(vec AS DOUBLE[]), lambda x: (x / 255.0 - {m[c]!r}) / {s[c]!r})" for c in range(3)]
    return _rl(" || ".join(parts))


@query("normalize_channels", f"SELECT id, {_norm_sql()} AS normed FROM v_img")
def q_normalize_channels(spark, sf):
    rgb = ar.replicate_channels(F.col("vec"))
    return Views(spark, sf).v_img().select(
        "id", ar.round_array(ar.normalize_channels(rgb, F.size("vec"))).alias("normed"))


_FLIP_SQL = f"({sql_hash('id', chr(39) + 'flip' + chr(39))} % 2 = 1 AND {sql_hash('id', chr(39) + 'media' + chr(39))} % 5 <> 0)"


@query("augment_flip", f"""SELECT id, {_FLIP_SQL} AS flipped,
    CASE WHEN {_FLIP_SQL}
         THEN flatten(list_transform(range(8), lambda r: list_reverse(vec[r * 8 + 1:r * 8 + 8]))) ELSE vec END AS vec
    FROM v_img""")
def q_augment_flip(spark, sf):
    """Half of the training rows are mirrored, no test row is."""
    coin = ((hash_key(F.col("id"), "flip") % 2) == 1) & (hash_key(F.col("id"), "media") % 5 != 0)
    return Views(spark, sf).v_img().select(
        "id", coin.alias("flipped"), F.when(coin, ar.flip_rows(F.col("vec"), 8, 8)).otherwise(F.col("vec")).alias("vec"))


@query("cast_features", """SELECT t.id, CAST([f_acctbal, f_n, f_spend, f_avg, f_max] AS FLOAT[]) AS x, i.idx AS y
    FROM v_tab t JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
                       FROM (SELECT DISTINCT label FROM v_tab) d) i USING (label)""")
def q_cast_features(spark, sf):
    t = Views(spark, sf).v_tab()
    e = prep.label_encode(t, "label", prep.label_index(t, "label"))
    return e.select("id", F.array("f_acctbal", "f_n", "f_spend", "f_avg", "f_max").cast("array<float>").alias("x"),
                    F.col("idx").cast("int").alias("y"))


# ------------------------------------------------------------- epochs / paths
@query("running_best", """SELECT epoch, acc, prev_best, acc > coalesce(prev_best, 0.0) AS improved,
    (SELECT epoch FROM v_epoch ORDER BY acc DESC, epoch LIMIT 1) AS best_epoch
    FROM (SELECT *, max(acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best
          FROM v_epoch) e""")
def q_running_best(spark, sf):
    e = Views(spark, sf).v_epoch()
    best = e.agg(F.max_by("epoch", F.struct(F.col("acc"), -F.col("epoch")))).first()[0]
    return (running_before(e, ["epoch"], "acc", "prev_best")
            .withColumn("improved", F.col("acc") > F.coalesce(F.col("prev_best"), F.lit(0.0)))
            .withColumn("best_epoch", F.lit(best).cast("int")))


@query("sort_paths", "SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal FROM pages")
def q_sort_paths(spark, sf):
    p = Views(spark, sf).t("pages").select("page_id", "url")
    return rank_within(p, ["url", "page_id"], [], rank_col="ordinal")


@query("union_all_sources", """SELECT page_id, url, src, row_number() OVER (ORDER BY src, url, page_id) - 1 AS ordinal FROM (
    SELECT page_id, url, 0 AS src FROM pages WHERE starts_with(url, 'https://')
    UNION ALL SELECT page_id, url, 1 AS src FROM pages WHERE starts_with(url, 'http://')) u""")
def q_union_all_sources(spark, sf):
    p = Views(spark, sf).t("pages").select("page_id", "url")
    a = p.where(F.col("url").startswith("https://")).withColumn("src", F.lit(0))
    b = p.where(F.col("url").startswith("http://")).withColumn("src", F.lit(1))
    return rank_within(a.unionByName(b), ["src", "url", "page_id"], [], rank_col="ordinal")
