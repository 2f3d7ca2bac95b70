"""DuckDB twins of ``tessera.plans.views`` for the oracle SQL."""

from __future__ import annotations

import re

from tessera.functions.hashing import sql_hash


def _h(key: str, salt: str) -> str:
    return sql_hash(key, f"'{salt}'")


VIEW_SQL: dict[str, str] = {
    "v_tab": """
        SELECT c.c_custkey AS id, c.c_acctbal AS f_acctbal,
               CAST(coalesce(o.f_n, 0) AS BIGINT) AS f_n, o.f_spend, o.f_avg, o.f_max,
               c.c_mktsegment AS label
        FROM customer c LEFT JOIN (
            SELECT o_custkey, count(*) AS f_n, round(sum(o_totalprice), 6) AS f_spend,
                   round(avg(o_totalprice), 6) AS f_avg, max(o_totalprice) AS f_max
            FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
            GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""",
    "v_img": "SELECT vec_id AS id, embedding AS vec, label FROM embeddings",
    "v_sig": """
        SELECT user_id AS id, list(value ORDER BY ts, event_id) AS sig
        FROM events GROUP BY user_id""",
    "v_cls": """
        SELECT doc_id AS id,
               [CAST(n_chars AS DOUBLE),
                CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE),
                CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE),
                CAST(n_chars AS DOUBLE) / CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE)] AS vec,
               CASE WHEN quality = 1 AND toxic = 0 THEN 'Healthy'
                    WHEN quality = 1 AND toxic = 1 THEN 'Mild_Stress'
                    WHEN quality = 0 AND toxic = 0 THEN 'Moderate_Stress'
                    ELSE 'Severe_Stress' END AS label
        FROM labels JOIN documents USING (doc_id)""",
    "v_pred": f"""
        SELECT id, y_true, y_pred,
               CASE WHEN y_pred = 'Mild_Stress' THEN 'Healthy' ELSE y_pred END AS y_pred_b,
               [r0 / (r0 + r1 + r2 + r3), r1 / (r0 + r1 + r2 + r3),
                r2 / (r0 + r1 + r2 + r3), r3 / (r0 + r1 + r2 + r3)] AS scores
        FROM (
          SELECT id, label AS y_true,
                 CASE WHEN vec[1] < 100 THEN 'Severe_Stress' WHEN vec[1] < 500 THEN 'Moderate_Stress'
                      WHEN vec[1] < 1000 THEN 'Mild_Stress' ELSE 'Healthy' END AS y_pred,
                 CAST(1 + {_h('id', '0')} % 100 AS DOUBLE) AS r0,
                 CAST(1 + {_h('id', '1')} % 100 AS DOUBLE) AS r1,
                 CAST(1 + {_h('id', '2')} % 100 AS DOUBLE) AS r2,
                 CAST(1 + {_h('id', '3')} % 100 AS DOUBLE) AS r3
          FROM v_cls) q""",
    "v_pred_long": """
        SELECT id, y_true, 'rule_a' AS model, y_pred, scores FROM v_pred
        UNION ALL
        SELECT id, y_true, 'rule_b' AS model, y_pred_b AS y_pred, scores FROM v_pred""",
    "v_emap": """
        SELECT * FROM (VALUES ('signup', 'Healthy'), ('view', 'Mild_Stress'),
            ('click', 'Mild_Stress'), ('purchase', 'Moderate_Stress'),
            ('error', 'Severe_Stress')) t(event_type, label)""",
    "v_req": """
        SELECT event_id AS id,
               CASE WHEN event_id % 17 = 0 THEN '' ELSE 'a/' || CAST(event_id AS VARCHAR) END AS audio_path,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'i/' || CAST(event_id AS VARCHAR) END AS image_path,
               CAST(nullif(k % 60, 13) AS DOUBLE) AS depression,
               CAST(CAST(floor(value) AS BIGINT) % 60 AS DOUBLE) AS anxiety,
               CAST((k * 7) % 55 AS DOUBLE) AS stress,
               CAST(k % 12 AS DOUBLE) AS sleep
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e""",
    "v_epoch": """
        SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS epoch, acc
        FROM (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS acc
              FROM events GROUP BY 1) d""",
}

_ORDER = ["v_tab", "v_img", "v_sig", "v_cls", "v_pred", "v_pred_long", "v_emap", "v_req", "v_epoch"]
_DEPS = {"v_pred": ["v_cls"], "v_pred_long": ["v_pred"]}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it mentions."""
    extra = extra or {}
    allsql = dict(VIEW_SQL)
    allsql.update(extra)
    order = _ORDER + [k for k in extra if k not in _ORDER]
    need: set[str] = set()

    def visit(name: str):
        if name in need:
            return
        need.add(name)
        for d in _DEPS.get(name, []):
            visit(d)
        for other in allsql:
            if other != name and re.search(rf"\b{other}\b", allsql[name]):
                visit(other)

    for name in allsql:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({allsql[n]})" for n in order if n in need)
    m = re.match(r"\s*WITH\s+", sql, re.I)
    if m:
        return f"WITH {ctes},\n{sql[m.end():]}"
    return f"WITH {ctes}\n{sql}"
