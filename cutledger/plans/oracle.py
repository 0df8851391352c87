"""SQL restatement of the subject tables, used to build the DuckDB side of each check."""

from __future__ import annotations

import re

CTES = {
    "user_events": """SELECT event_id AS id,
      CASE event_type WHEN 'signup' THEN 'workspace_started' WHEN 'view' THEN 'first_dxf_uploaded'
        WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'nest_completed' ELSE 'paywall_viewed' END
        WHEN 'purchase' THEN 'payment_succeeded' ELSE 'payment_failed' END AS event_type,
      CASE WHEN event_type IN ('signup','view') OR (event_type = 'click' AND event_id % 2 = 1) THEN 'low'
        ELSE 'critical' END AS priority,
      CASE WHEN event_type = 'purchase' THEN CASE user_id % 3
          WHEN 0 THEN '{"payment_method": "sinpe_crc", "currency": "crc"}'
          WHEN 1 THEN '{"payment_method": "card_crc", "currency": "crc"}'
          ELSE '{"payment_method": "card_usd", "currency": "usd"}' END ELSE props END AS properties,
      CASE WHEN event_type = 'purchase' THEN CASE user_id % 3 WHEN 0 THEN 'sinpe_crc' WHEN 1 THEN 'card_crc'
          ELSE 'card_usd' END END AS p_method,
      CASE WHEN event_type = 'purchase' THEN CASE user_id % 3 WHEN 2 THEN 'usd' ELSE 'crc' END END AS p_currency,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
      's-' || user_id AS anonymous_session_key, 't-' || event_id % 7 AS tab_id, user_id % 40 AS project_id,
      CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN event_id % 300 END AS nesting_run_id,
      CASE WHEN event_id % 50 = 0 THEN '10.0.0.1' WHEN event_id % 51 = 0 THEN 'bad-ip' ELSE
        (1 + user_id % 220) || '.' || (event_id % 256) || '.' || ((event_id * 7) % 256) || '.' || ((event_id * 13) % 256)
        END AS ip,
      'ua-' || event_id % 5 AS user_agent,
      CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'CR' ELSE 'US' END AS country_code,
      CASE user_id % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END AS locale,
      CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'k-' || (event_id - event_id % 3) END AS idempotency_key,
      ts AS occurred_at FROM events""",
    "payments0": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
      CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
      CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'sinpe_crc' WHEN '2' THEN 'sinpe_crc' WHEN '5' THEN 'card_usd'
        ELSE 'card_crc' END AS payment_method,
      CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
      CASE WHEN o_orderkey % 4 = 0 THEN 'plan_subscription' ELSE 'single_download' END AS purpose,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 300 END AS nesting_run_id,
      CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN o_orderkey END AS subscription_id,
      CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS superseded_at FROM orders""",
    "payments": """SELECT *, CASE WHEN payment_method = 'card_usd' THEN 'usd' ELSE 'crc' END AS currency,
      amount AS list_price,
      CAST(CASE WHEN id % 6 = 0 THEN 10 ELSE 0 END AS DECIMAL(12,2)) AS discount_amount,
      CAST(amount - CASE WHEN id % 6 = 0 THEN 10 ELSE 0 END AS DECIMAL(12,2)) AS subtotal,
      CAST(round(CAST(amount - CASE WHEN id % 6 = 0 THEN 10 ELSE 0 END AS DECIMAL(12,2)) * CAST(0.13 AS DECIMAL(3,2)), 2)
        AS DECIMAL(12,2)) AS tax_amount,
      CASE WHEN id % 7 = 0 THEN CAST(0 AS DECIMAL(12,2))
        ELSE CAST(round(amount * CAST(1.13 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) END AS total_amount,
      CASE WHEN purpose = 'single_download' THEN 'single_download'
        ELSE 'plan_' || [1,2,4][id % 3 + 1] || '_months' END AS product_description,
      CASE WHEN status = 'succeeded' THEN created_at + to_minutes(id % 30) END AS paid_at,
      'Name_' || user_id AS purchaser_name, 'user' || user_id || '%' || id % 10 || '@Example.com' AS purchaser_email,
      CASE WHEN purpose = 'single_download' THEN lpad(CAST(id AS VARCHAR), 12, '0') END AS purchase_reference,
      CASE WHEN payment_method = 'sinpe_crc' THEN 'ID' || user_id END AS sinpe_transfer_identification,
      CASE WHEN payment_method = 'sinpe_crc' THEN '8' || lpad(CAST(user_id AS VARCHAR), 7, '0') END
        AS sinpe_transfer_mobile_number,
      CASE WHEN id % 2 = 0 THEN 'onvo' END AS gateway_provider,
      CASE WHEN id % 2 = 0 AND id % 14 <> 0 THEN 'pi_' || id END AS onvo_payment_intent_id,
      CASE WHEN id % 2 = 0 THEN 'test' END AS onvo_mode,
      CASE WHEN id % 2 = 0 THEN CASE status WHEN 'succeeded' THEN 'succeeded' WHEN 'failed' THEN 'requires_payment_method'
        ELSE ['processing','canceled','requires_action'][id % 3 + 1] END END AS gateway_status,
      CASE WHEN id % 13 = 0 THEN '' WHEN id % 3 = 0 THEN NULL ELSE '8314200000100' END AS cabys_code,
      CASE WHEN id % 19 = 0 AND status <> 'succeeded' THEN created_at + INTERVAL 5 MINUTE END AS checkout_abandoned_at,
      CASE WHEN id % 17 = 0 AND status = 'pending' THEN created_at + INTERVAL 10 MINUTE END AS checkout_lock_released_at,
      CASE WHEN id % 17 = 0 AND status = 'pending' THEN CASE WHEN id % 2 = 0 THEN 'timeout' ELSE 'odd_reason' END END
        AS checkout_lock_reason FROM payments0""",
    "users": """SELECT c_custkey AS id, 'User' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email,
      c_name AS name,
      CASE c_nationkey % 3 WHEN 0 THEN 'America/Costa_Rica' WHEN 1 THEN 'America/New_York' ELSE 'UTC' END AS time_zone,
      CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '1994-01-01' END AS confirmed_at,
      CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '1996-01-01' END AS suspended_at FROM customer""",
    "subscriptions": """SELECT o_orderkey AS id, o_custkey AS user_id, [1,2,4][o_orderkey % 3 + 1] AS tier_months,
      o_orderdate AS starts_at,
      CAST(CAST(o_orderdate AS DATE) + to_months([1,2,4][o_orderkey % 3 + 1]) AS TIMESTAMP)
        + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS ends_at
      FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'F'""",
    "download_grants": """SELECT *, CASE WHEN id % 8 = 1 THEN 'plan_included' ELSE 'single_purchase' END AS kind,
      CASE WHEN id % 5 = 0 THEN NULL ELSE updated_at + to_days(CAST(id % 400 AS INTEGER)) END AS retained_until
      FROM (SELECT o_custkey AS user_id, o_orderkey % 300 AS nesting_run_id, max(o_orderkey) AS id,
        min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 GROUP BY 1, 2)""",
    "downloads": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 300 AS nesting_run_id,
      o_orderdate + INTERVAL 3 DAY AS downloaded_at, o_orderkey % 6 = 0 AS via_token FROM orders""",
    "usages": """SELECT l_orderkey AS subscription_id, year(l_shipdate) AS period_year, month(l_shipdate) AS period_month,
      CAST(least(sum(l_quantity), 50) AS INTEGER) AS downloads_used, min(l_shipdate) AS created_at, 50 AS quota_limit
      FROM lineitem GROUP BY 1, 2, 3""",
    "quotes": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'plan' ELSE 'single_download' END AS product,
      CASE WHEN o_orderkey % 9 <> 0 THEN [1,2,4,3][o_orderkey // 4 % 4 + 1] END AS tier_months,
      o_orderkey % 5 = 0 AS overage, CASE WHEN o_orderkey % 3 = 0 THEN 'usd' ELSE 'crc' END AS currency,
      CASE WHEN o_orderkey % 2 = 0 THEN 'sinpe' ELSE 'card' END AS billing_method, o_orderkey % 3 <> 0 AS iva_applicable
      FROM orders""",
    "price_rows": """SELECT * FROM (VALUES ('single_download', 0, false, 1200, 1000, 2.50), ('single_download', 0, true, 600, 500, 1.25),
      ('plan', 1, false, 3250, 3000, 7.00), ('plan', 2, false, 5300, 5000, 11.50), ('plan', 4, false, 8400, 8000, 18.00))
      AS v(product, tier, overage, official, sinpe, card_usd)""",
    "visits": """SELECT id, ip, CASE WHEN id % 4 = 0 THEN ' cr' WHEN id % 7 = 0 THEN ' ' END AS header_country,
      CASE WHEN user_id % 3 = 0 THEN 'America/Costa_Rica' WHEN user_id % 3 = 1 THEN 'UTC' END AS time_zone,
      CASE WHEN id % 3 = 0 THEN 'US' END AS session_country FROM user_events""",
    "ip_numbers": """SELECT id, ip, CASE WHEN ip LIKE '%.%.%.%' THEN split_part(ip, '.', 1)::BIGINT * 16777216
      + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS n
      FROM user_events""",
    "carts": """SELECT id, user_id, guest_token, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 300 END AS nesting_run_id,
      CASE WHEN c_nationkey % 3 <> 0 THEN [1,2,4][c_custkey % 3 + 1] END AS tier_months,
      CASE WHEN c_nationkey % 4 = 0 THEN 'usd' ELSE 'crc' END AS currency_mode,
      1000 + c_custkey % 7 * 100 AS list_price_cents, 1050 + c_custkey % 5 * 100 AS sinpe_price_cents FROM (
      SELECT c_custkey * 2 AS id, c_custkey AS user_id, NULL AS guest_token, c_custkey, c_nationkey
        FROM customer WHERE c_acctbal >= 5000
      UNION ALL SELECT c_custkey * 2 + 1, NULL, 'g-' || c_custkey, c_custkey, c_nationkey FROM customer)""",
    "logins": "SELECT 'g-' || c_custkey AS guest_token, c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')",
    "runs": """SELECT *, CASE o_orderstatus WHEN 'F' THEN CASE WHEN id % 3 = 0 THEN 'partial' ELSE 'completed' END
        WHEN 'P' THEN 'failed' ELSE 'processing' END AS status,
      make_timestamp(s0 * 1000000) AS created_at,
      CASE WHEN id % 17 <> 0 THEN make_timestamp((s0 + id % 7) * 1000000) END AS started_at,
      CASE WHEN o_orderstatus <> 'O' THEN make_timestamp((s0 + 7 + o_custkey % 900) * 1000000) END AS finished_at,
      CASE WHEN id % 29 = 0 THEN make_timestamp((s0 + 60) * 1000000) END AS cancel_requested_at,
      CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS exit_code, id % 23 <> 0 AS has_output,
      CASE WHEN id % 41 = 0 THEN 'unknown' WHEN id % 3 = 0 THEN 'partial' ELSE 'completed' END AS report_status,
      id % 4 AS n_orphans, id % 31 = 0 AS warned_cancelled
      FROM (SELECT o_orderkey AS id, o_orderkey % 40 AS project_id, o_custkey, o_orderstatus,
        1704067200 + (o_orderkey * 173) % 2592000 AS s0 FROM orders)""",
    "run_orphans": """SELECT id AS run_id, i AS piece_index,
      CASE WHEN (id + i) % 2 = 0 THEN 'oversized_for_sheet' ELSE 'no_sheet_capacity' END AS reason
      FROM runs, unnest(range(n_orphans)) AS t(i)""",
    "doc_sheets": """SELECT o_orderkey AS run_id, s AS sheet_index, 700.0::DOUBLE + 100 * s AS width_mm,
      700.0::DOUBLE AS height_mm, (2 - s) * 900.0::DOUBLE AS offset_x_mm, (o_orderkey + s) % 4 AS n_pieces
      FROM orders, unnest(range(o_orderkey % 3 + 1)) AS t(s)""",
    "doc_pieces": """SELECT run_id, sheet_index, sheet_index * 4 + p AS piece_index, p * 100.5::DOUBLE AS x_mm,
      p * 50.0::DOUBLE AS y_mm, p * 90.0::DOUBLE AS rotation_deg FROM doc_sheets, unnest(range(n_pieces)) AS t(p)""",
    "progress": """SELECT event_id AS id, user_id AS run_id, ts AS t_at,
      CASE WHEN event_id % 10 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS version,
      ['extracting','fill','optimizing','consolidating','refining','writing_outputs','bogus'][event_id % 7 + 1] AS phase_id,
      CAST(floor(value) AS INTEGER) AS percent, 40 AS pieces_total, CAST(event_id % 41 AS INTEGER) AS pieces_placed,
      CAST(event_id % 600 AS INTEGER) AS eta_sec FROM events""",
    "valid_progress": """SELECT * FROM progress WHERE version IN (1, 2) AND phase_id <> 'bogus'
      AND percent BETWEEN 0 AND 100""",
    "pieces": """SELECT l_orderkey AS project_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS piece_index,
      l_quantity * 20 AS width_mm, (p_size + 1) * 15.0::DOUBLE AS height_mm, p_size % 3 AS kind, l_partkey,
      l_returnflag AS layer,
      l_quantity * 20 * (p_size + 1) * 15.0::DOUBLE * CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS area
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "stocks": """SELECT o_orderkey * 2 + k AS id, o_orderkey AS project_id,
      CASE WHEN k = 0 THEN 700.0::DOUBLE ELSE 1220.0::DOUBLE END AS width_mm,
      CASE WHEN k = 0 THEN 700.0::DOUBLE ELSE 1000.0::DOUBLE END AS height_mm,
      CASE WHEN k = 1 AND o_orderkey % 3 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS quantity,
      CASE WHEN o_orderkey % 2 = 0 THEN k ELSE 1 - k END AS sort_order
      FROM orders, (VALUES (0), (1)) AS v(k)""",
    "placed": """SELECT project_id AS run_id, piece_index % 2 AS sheet_index, piece_index,
      CAST((piece_index * 211 + project_id * 17) % 700 AS DOUBLE) AS x_mm,
      CAST((piece_index * 131 + project_id * 29) % 500 AS DOUBLE) AS y_mm, width_mm, height_mm, kind, area FROM pieces""",
    "layers": """SELECT p_partkey AS id, p_partkey % 200 AS project_id,
      CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 400 END AS attachment_id, p_brand AS layer_name,
      CASE WHEN p_partkey % 5 <> 0 THEN '#' || p_size END AS color,
      CASE p_size % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'auxiliary' END AS layer_role,
      p_partkey % 4 <> 0 AS included, p_partkey % 2 = 0 AS auto_close_gaps, p_size % 4 AS n_gaps, p_partkey FROM part""",
    "layer_gaps": """SELECT id, i AS gap_no, (p_partkey * i) % 2000 / 100.0::DOUBLE AS distance_mm
      FROM layers, unnest(range(1, n_gaps + 1)) AS t(i)""",
    "resolutions": """SELECT o_orderkey AS id, o_orderkey % 500 AS project_id,
      CAST(o_orderkey // 500 AS VARCHAR) AS piece_key,
      CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'pending' ELSE 'split_ready' END AS resolution_state
      FROM orders""",
    "proposals": """SELECT l_orderkey * 16 + l_linenumber AS id, l_orderkey AS orphan_resolution_id,
      l_linenumber AS version, CASE max(l_returnflag) WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'draft' ELSE 'rejected' END
        AS status FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "derived": """SELECT o_orderkey AS id, o_orderkey % 500 AS project_id,
      CAST(o_orderkey // 500 AS VARCHAR) AS parent_piece_key FROM orders WHERE o_orderpriority LIKE '1%'""",
    "entities": """SELECT project_id * 64 + piece_index AS id, project_id % 100 AS drawing_id,
      CASE layer WHEN 'A' THEN 'CUT' WHEN 'N' THEN 'MARK' ELSE 'ENGRAVE' END AS layer,
      ['LWPOLYLINE','CIRCLE','LINE','TEXT','ARC','HATCH','POINT'][
        (l_partkey + CASE WHEN layer = 'A' THEN 0 ELSE piece_index END) % CASE WHEN layer = 'A' THEN 3 ELSE 7 END + 1] AS etype,
      CAST(power((project_id * 64 + piece_index) % 9973, 2) * 31 % 6007 AS DOUBLE) AS min_x,
      CAST(power((project_id * 64 + piece_index) % 7919, 2) * 17 % 6011 AS DOUBLE) AS min_y,
      CAST(power((project_id * 64 + piece_index) % 9973, 2) * 31 % 6007 AS DOUBLE) + width_mm / 20 AS max_x,
      CAST(power((project_id * 64 + piece_index) % 7919, 2) * 17 % 6011 AS DOUBLE) + height_mm / 15 AS max_y FROM pieces""",
    "contours": """SELECT project_id * 64 + piece_index AS id, project_id AS drawing_id, layer,
      piece_index * 10.0::DOUBLE AS x0, piece_index * 10.0::DOUBLE AS y0, width_mm, height_mm FROM pieces""",
    "circles": """SELECT project_id * 64 + piece_index AS id, project_id AS drawing_id, layer,
      (piece_index % 2) * 500.0::DOUBLE + (l_partkey % 3) * 0.5::DOUBLE AS cx, (l_partkey % 2) * 0.5::DOUBLE AS cy,
      width_mm / 10 AS r FROM pieces""",
    "plates": """SELECT project_id * 128 + piece_index * 2 AS id, project_id AS drawing_id, piece_index, kind, layer,
      width_mm AS w, height_mm AS h, [0.5, 1, 1.2][l_partkey % 3 + 1]::DOUBLE AS f FROM pieces""",
    "ip_ranges": """SELECT c_custkey * 2000000 AS ip_from, c_custkey * 2000000 + 1499999 AS ip_to,
      chr(CAST(65 + c_nationkey % 26 AS INTEGER)) || chr(CAST(65 + (c_nationkey * 7) % 26 AS INTEGER)) AS country_code
      FROM customer""",
    "feedbacks": """SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS user_id,
      ['suggestion','bug','other','praise'][turn % 4 + 1] AS feedback_type,
      ['pending','reviewed','archived'][conv_id % 3 + 1] AS status,
      CASE WHEN turn % 5 = 4 THEN ' ok ' ELSE text END AS message,
      CASE WHEN conv_id % 4 <> 0 THEN ' Conv' || conv_id || '@Mail.example ' END AS email,
      make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS created_at FROM conversations""",
    "gateway_events": """SELECT 'pi_' || CASE WHEN l_linenumber = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END
        AS payment_intent_id,
      CASE l_returnflag WHEN 'A' THEN 'payment-intent.succeeded' WHEN 'R' THEN 'payment-intent.failed'
        ELSE 'payment-intent.deferred' END AS type, l_shipdate AS t_at,
      l_orderkey * 1000000 + l_partkey * 8 + l_linenumber AS event_no FROM lineitem""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def oracle(sql: str) -> str:
    """Prefix a query with the subject tables it names, in dependency order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                visit(dep)
        seen.append(name)

    for name in _needs(sql):
        visit(name)
    body = sql.strip()
    if not seen:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in seen)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def stamp(col: str) -> str:
    """Timestamp as text with microseconds, as the Spark side prints it."""
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"
