"""The queries in SQL for DuckDB, written apart from the DataFrame operators.

``WITH`` parts are named once and put together by need; a query's own text comes last.
"""

from __future__ import annotations

import re

from tidemark.operators.encode import past_inputs
from tidemark.schemas import BINARY, BTAGS, CATEGORICAL, COUNTS, ENTITIES, HISTORY_FLAGS, METRICS, MODEL_COUNTS, PROFILE, RECENCIES, WINDOWS, index_name

_MID = "(epoch(CAST({d} AS TIMESTAMP)) - 28800)"


def _f(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _windows(keys: str) -> str:
    sums = ", ".join(f"coalesce(sum(d.{m}_count) FILTER (WHERE d.event_date_bj >= k.event_date_bj - {w}), 0) AS {m}_count_{w}d" for w in WINDOWS for m in METRICS)
    mid = _MID.format(d="k.event_date_bj")
    return f"""SELECT k.user_raw, k.event_date_bj, 1 AS {HISTORY_FLAGS[0]},
        CAST(coalesce(sum(d.buy_count), 0) > 0 AS INTEGER) AS {HISTORY_FLAGS[1]}, {sums},
        {_f(f"({mid} - max(d.last_event_timestamp)) / 86400.0")} AS {RECENCIES[0]},
        {_f(f"({mid} - max(d.last_buy_timestamp)) / 86400.0")} AS {RECENCIES[1]}
        FROM ({keys}) k JOIN daily d ON d.user_raw = k.user_raw AND d.event_date_bj BETWEEN k.event_date_bj - 14 AND k.event_date_bj - 1
        GROUP BY k.user_raw, k.event_date_bj"""


def _vocab(f: str) -> str:
    if f == "hour":
        return "SELECT CAST(x AS INTEGER) AS hour, x + 2 AS idx FROM range(0, 24) t(x)"
    if f == "day_of_week":
        return "SELECT CAST(x AS INTEGER) AS day_of_week, x + 1 AS idx FROM range(1, 8) t(x)"
    return f"SELECT {f}, row_number() OVER (ORDER BY {f}) + 1 AS idx FROM (SELECT DISTINCT {f} FROM cbase WHERE split = 'train' AND {f} IS NOT NULL)"


def _entity(name: str, column: str) -> str:
    return f"""SELECT {column}, event_date_bj, i AS {name}_past_impressions, k AS {name}_past_clicks,
        {_f("(k + 100.0 * global_past_ctr) / (i + 100.0)")} AS {name}_past_ctr, i > 0 AS {name}_has_past_feedback
        FROM (SELECT {column}, event_date_bj, coalesce(sum(n) OVER w, 0) AS i, coalesce(sum(c) OVER w, 0) AS k
              FROM (SELECT {column}, event_date_bj, count(*) AS n, sum(clk) AS c FROM imp WHERE {column} IS NOT NULL GROUP BY ALL)
              WINDOW w AS (PARTITION BY {column} ORDER BY event_date_bj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        JOIN overall USING (event_date_bj)"""


def _past() -> str:
    cols, joins = [], []
    for n, c in ENTITIES.items():
        joins.append(f"LEFT JOIN ent_{n} e_{n} ON e_{n}.{c} = imp.{c} AND e_{n}.event_date_bj = imp.event_date_bj")
        cols += [
            f"coalesce(e_{n}.{n}_past_impressions, 0) AS {n}_past_impressions", f"coalesce(e_{n}.{n}_past_clicks, 0) AS {n}_past_clicks",
            f"coalesce(e_{n}.{n}_past_ctr, overall.global_past_ctr) AS {n}_past_ctr", f"coalesce(e_{n}.{n}_has_past_feedback, false) AS {n}_has_past_feedback",
        ]
    return f"SELECT imp.*, global_past_impressions, global_past_clicks, global_past_ctr, {', '.join(cols)} FROM imp LEFT JOIN overall USING (event_date_bj) {' '.join(joins)}"


def _model_input() -> str:
    joins = " ".join(f"LEFT JOIN v_{f} ON v_{f}.{f} = feat.{f}" for f in CATEGORICAL)
    cols = [f"coalesce(v_{f}.idx, 1) AS {index_name(f)}" for f in CATEGORICAL]
    cols += [f"coalesce({b}, 0) AS {b}" for b in BINARY]
    cols += ["coalesce(log_price, (SELECT median(log_price) FROM cbase WHERE split = 'train')) AS log_price"]
    cols += [_f(f"ln(1 + {c})") + f" AS log1p_{c}" for c in MODEL_COUNTS] + [f"coalesce({r}, 15.0) AS {r}" for r in RECENCIES]
    return f"SELECT impression_id, event_date_bj, clk, split, {', '.join(cols)} FROM feat {joins} WHERE split <> 'out_of_range'"


def _f3() -> str:
    numeric, flags = past_inputs()
    cols = [(_f(f"ln(1 + {c.removesuffix('_log')})") + f" AS {c}") if c.endswith("_log") else c for c in numeric] + [f"CAST({c} AS INTEGER) AS {c}" for c in flags]
    return f"SELECT m.*, p.* EXCLUDE (impression_id) FROM minput m LEFT JOIN (SELECT impression_id, {', '.join(cols)} FROM past) p USING (impression_id)"


PARTS: dict[str, str] = {
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS time_stamp FROM events",
    "smp": """SELECT event_id AS impression_id, user_id AS "user", time_stamp, k AS adgroup_id, CASE WHEN event_id % 3 = 0 THEN 'P1' ELSE 'P2' END AS pid,
        CAST(event_type <> 'click' AS INTEGER) AS nonclk, CAST(event_type = 'click' AS INTEGER) AS clk, floor(value / 600 * 10000 + 0.5) / 10000 AS prediction
        FROM ev WHERE event_type IN ('view', 'click')""",
    "lg": """SELECT user_id AS "user", time_stamp, CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'fav' WHEN 'purchase' THEN 'buy' ELSE event_type END AS btag,
        k AS cate, k % 7 AS brand FROM ev""",
    "ads": """SELECT p_partkey AS adgroup_id, p_type AS cate_id, CAST(p_size AS BIGINT) AS campaign_id, p_partkey % 17 AS customer, nullif(p_brand, 'Brand#2') AS brand,
        CASE WHEN p_size = 50 THEN 99999999.0 ELSE p_retailprice END AS price FROM part""",
    "usr": """SELECT c_custkey AS userid, CAST(c_nationkey AS BIGINT) AS cms_segid, CAST(c_nationkey % 13 AS BIGINT) AS cms_group_id, c_custkey % 2 + 1 AS final_gender_code, c_custkey % 7 AS age_level,
        CAST(nullif(c_custkey % 4, 0) AS DOUBLE) AS pvalue_level, c_custkey % 3 + 1 AS shopping_level, c_custkey % 2 AS occupation, CAST(nullif(c_custkey % 5, 0) AS DOUBLE) AS new_user_class_level
        FROM customer WHERE c_acctbal >= 0""",
    "base": f"""SELECT impression_id, "user" AS user_raw, s.time_stamp, s.adgroup_id AS adgroup_id_raw, pid AS pid_raw, clk, cate_id AS cate_id_raw, campaign_id AS campaign_id_raw, customer AS customer_raw,
        brand AS brand_raw, price AS price_raw, CAST(price = 99999999 AS INTEGER) AS price_is_sentinel, CASE WHEN a.adgroup_id IS NOT NULL THEN CAST(brand IS NULL AS INTEGER) END AS brand_is_missing,
        CASE WHEN price = 99999999 THEN NULL ELSE price END AS price_clean, {_f("ln(1 + CASE WHEN price = 99999999 THEN NULL ELSE price END)")} AS log_price,
        {', '.join(f'CAST({p} AS INTEGER) AS {p}' for p in PROFILE)}, CAST(userid IS NOT NULL AS INTEGER) AS has_profile,
        make_timestamp(s.time_stamp * 1000000) AS event_time_utc, make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR AS event_time_bj,
        CAST(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR AS DATE) AS event_date_bj,
        hour(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR) AS hour, isodow(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR) AS day_of_week,
        CASE WHEN CAST(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-28' THEN 'train'
             WHEN CAST(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-29' THEN 'val'
             WHEN CAST(make_timestamp(s.time_stamp * 1000000) + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-30' THEN 'test' ELSE 'out_of_range' END AS split
        FROM smp s LEFT JOIN ads a ON a.adgroup_id = s.adgroup_id LEFT JOIN usr ON userid = "user" """,
    "cbase": "SELECT * FROM base WHERE NOT (split = 'train' AND (user_raw % 10 = 7 OR adgroup_id_raw % 10 = 3))",
    "daily": f"""SELECT "user" AS user_raw, CAST(make_timestamp(time_stamp * 1000000) + INTERVAL 8 HOUR AS DATE) AS event_date_bj, count(*) AS event_count,
        {', '.join(f"count(*) FILTER (WHERE btag = '{t}') AS {t}_count" for t in BTAGS)}, max(time_stamp) AS last_event_timestamp, max(time_stamp) FILTER (WHERE btag = 'buy') AS last_buy_timestamp
        FROM lg WHERE btag IN ('pv', 'cart', 'fav', 'buy') AND time_stamp >= epoch(TIMESTAMP '2024-01-01') - 28800 AND time_stamp < epoch(TIMESTAMP '2024-01-31') - 28800 GROUP BY 1, 2""",
    "win": _windows("SELECT DISTINCT user_raw, event_date_bj FROM base"),
    "look": _windows("SELECT DISTINCT d.user_raw, CAST(DATE '2024-01-22' + CAST(t.x AS INTEGER) AS DATE) AS event_date_bj FROM daily d, range(0, 9) t(x)"),
    "bfeat": f"SELECT base.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*HISTORY_FLAGS, *COUNTS])}, {', '.join(RECENCIES)} FROM base LEFT JOIN win USING (user_raw, event_date_bj)",
    "feat": "SELECT bfeat.* FROM bfeat JOIN (SELECT impression_id FROM cbase) USING (impression_id)",
    "imp": f"SELECT impression_id, event_date_bj, split, clk, {', '.join(ENTITIES.values())} FROM cbase WHERE split <> 'out_of_range'",
    "overall": f"""SELECT event_date_bj, i AS global_past_impressions, k AS global_past_clicks, {_f("CASE WHEN i > 0 THEN k / CAST(i AS DOUBLE) ELSE 0.05 END")} AS global_past_ctr
        FROM (SELECT event_date_bj, coalesce(sum(n) OVER w, 0) AS i, coalesce(sum(c) OVER w, 0) AS k FROM (SELECT event_date_bj, count(*) AS n, sum(clk) AS c FROM imp GROUP BY 1)
              WINDOW w AS (ORDER BY event_date_bj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    **{f"ent_{n}": _entity(n, c) for n, c in ENTITIES.items()},
    "past": _past(),
    **{f"v_{f}": _vocab(f) for f in CATEGORICAL},
    "minput": _model_input(),
    "f3": _f3(),
    "pred": "SELECT c.*, s.prediction, c.user_raw IN (SELECT user_raw FROM cbase WHERE split = 'train') AS known_user, c.adgroup_id_raw IN (SELECT adgroup_id_raw FROM cbase WHERE split = 'train') AS known_ad FROM cbase c JOIN smp s USING (impression_id) WHERE c.split IN ('val', 'test')",
    "seg": "SELECT *, CASE WHEN known_user AND known_ad THEN 'known_user_known_ad' WHEN known_user THEN 'known_user_new_ad' WHEN known_ad THEN 'new_user_known_ad' ELSE 'new_user_new_ad' END AS segment FROM pred",
    "uauc": """SELECT split, user_raw, count(*) AS rows, sum(clk) AS positive_rows, sum(1 - clk) AS negative_rows,
        CASE WHEN sum(clk) > 0 AND sum(1 - clk) > 0 THEN (sum(clk * rk) - sum(clk) * (sum(clk) + 1) / 2.0) / (sum(clk) * sum(1 - clk)) END AS user_auc
        FROM (SELECT *, rank() OVER (PARTITION BY split, user_raw ORDER BY prediction) + (count(*) OVER (PARTITION BY split, user_raw, prediction) - 1) / 2.0 AS rk FROM pred) GROUP BY 1, 2""",
    "bins": "SELECT *, floor((row_number() OVER (PARTITION BY split ORDER BY prediction, impression_id) - 1) * 10 / count(*) OVER (PARTITION BY split)) + 1 AS bin FROM pred",
    "wbins": "SELECT *, least(greatest(floor(prediction * 20), 0), 19) + 1 AS bin FROM pred",
}


def with_parts(sql: str) -> str:
    """``sql`` behind the parts it names, and those they name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b|,\s*{name}\b(?=\s+[a-z])", text):
                visit(PARTS[name])
                need.append(name)

    visit(sql)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in need) + "\n" if need else "") + sql


def probability_metrics(source: str, by: str) -> str:
    q = "least(greatest(prediction, 1e-7), 1 - 1e-7)"
    return f"""SELECT {by}{', ' if by else ''}count(*) AS rows, sum(clk) AS clicks, avg(clk) AS actual_ctr, avg(prediction) AS mean_prediction,
        avg(-(clk * ln({q}) + (1 - clk) * ln(1 - {q}))) AS logloss, avg(pow(prediction - clk, 2)) AS brier,
        CASE WHEN avg(prediction) <> 0 THEN avg(clk) / avg(prediction) END AS copc, CASE WHEN avg(clk) <> 0 THEN 100 * (avg(prediction) / avg(clk) - 1) END AS bias_pct
        FROM {source} {'GROUP BY ' + by if by else ''}"""


def all_metrics(source: str, by: str) -> str:
    """AUC by comparing all pairs, average precision over distinct scores from the top."""
    return f"""SELECT m.*, a.auc, p.average_precision FROM ({probability_metrics(source, by)}) m
        LEFT JOIN (SELECT {by}, sum(CASE WHEN x.prediction > y.prediction THEN 1.0 WHEN x.prediction = y.prediction THEN 0.5 ELSE 0 END) / count(*) AS auc
                   FROM (SELECT {by}, prediction FROM {source} WHERE clk = 1) x JOIN (SELECT {by}, prediction FROM {source} WHERE clk = 0) y USING ({by}) GROUP BY {by}) a USING ({by})
        LEFT JOIN (SELECT {by}, sum(pos * tp / al) / sum(pos) AS average_precision FROM (
                     SELECT {by}, pos, sum(pos) OVER w AS tp, CAST(sum(n) OVER w AS DOUBLE) AS al
                     FROM (SELECT {by}, prediction, sum(clk) AS pos, count(*) AS n FROM {source} GROUP BY {by}, prediction)
                     WINDOW w AS (PARTITION BY {by} ORDER BY prediction DESC)) GROUP BY {by} HAVING sum(pos) > 0) p USING ({by})"""


def reliability(source: str, by: str) -> str:
    return f"""SELECT {by}, bin, count(*) AS rows, sum(clk) AS clicks, min(prediction) AS min_prediction, max(prediction) AS max_prediction, avg(prediction) AS mean_prediction,
        avg(clk) AS actual_ctr, abs(avg(prediction) - avg(clk)) AS gap, CASE WHEN avg(prediction) <> 0 THEN avg(clk) / avg(prediction) END AS copc FROM {source} GROUP BY {by}, bin"""


def checks(source: str, conditions: dict[str, str]) -> str:
    """``check``, ``violations`` of conditions on the rows of a part."""
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE {c}) AS violations FROM {source}" for n, c in conditions.items())


def stats(tbl: str | None, source: str, values: dict[str, str]) -> str:
    head = f"'{tbl}' AS tbl, " if tbl else ""
    return " UNION ALL ".join(f"SELECT {head}'{n}' AS stat, CAST({e} AS DOUBLE) AS value FROM {source}" for n, e in values.items())


def nearest(q: float, column: str) -> str:
    """Nearest quantile of a column within its group: element round(q (n - 1)) of the sorted values."""
    return f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))[CAST(floor({q} * (count({column}) - 1) + 0.5) AS BIGINT) + 1]"
