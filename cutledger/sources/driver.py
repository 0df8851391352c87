"""Test-table adapters: the driver's parquet tables shaped as the subject tables.

Every adapter is a projection, join or aggregate of the given tables; nothing is made up apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.session import prepare
from cutledger.sources.dims import VAT_RATE

EPOCH_2024 = 1_704_067_200
MONTH_SECONDS = 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, d: str) -> DataFrame:
    return shape_events(table(spark, d, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Raw event rows as product events (used for both the batch table and the stream)."""
    return raw.selectExpr(
        "event_id as id",
        """case event_type when 'signup' then 'workspace_started' when 'view' then 'first_dxf_uploaded'
           when 'click' then if(event_id % 2 = 0, 'nest_completed', 'paywall_viewed')
           when 'purchase' then 'payment_succeeded' else 'payment_failed' end as event_type""",
        """if(event_type in ('signup','view') or (event_type = 'click' and event_id % 2 = 1),
           'low', 'critical') as priority""",
        """if(event_type = 'purchase',
             case user_id % 3 when 0 then '{"payment_method": "sinpe_crc", "currency": "crc"}'
               when 1 then '{"payment_method": "card_crc", "currency": "crc"}'
               else '{"payment_method": "card_usd", "currency": "usd"}' end, props) as properties""",
        "if(event_id % 5 = 0, null, user_id) as user_id",
        "concat('s-', user_id) as anonymous_session_key",
        "concat('t-', event_id % 7) as tab_id",
        "user_id % 40 as project_id",
        "if(event_type = 'click' and event_id % 2 = 0, event_id % 300, null) as nesting_run_id",
        """case when event_id % 50 = 0 then '10.0.0.1' when event_id % 51 = 0 then 'bad-ip'
           else concat_ws('.', 1 + user_id % 220, event_id % 256, (event_id * 7) % 256, (event_id * 13) % 256)
           end as ip""",
        "concat('ua-', event_id % 5) as user_agent",
        "case user_id % 4 when 0 then null when 1 then 'CR' else 'US' end as country_code",
        "case user_id % 3 when 0 then 'es' when 1 then 'en' end as locale",
        "if(event_id % 10 = 0, null, concat('k-', event_id - event_id % 3)) as idempotency_key",
        "cast(ts as timestamp) as occurred_at",
    )


def payments(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id",
        "cast(o_orderdate as timestamp) as created_at",
        "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'pending' else 'failed' end as status",
        """case substr(o_orderpriority, 1, 1) when '1' then 'sinpe_crc' when '2' then 'sinpe_crc'
           when '5' then 'card_usd' else 'card_crc' end as payment_method""",
        "cast(o_totalprice as decimal(12,2)) as amount",
        "if(o_orderkey % 4 = 0, 'plan_subscription', 'single_download') as purpose",
        "if(o_orderkey % 4 = 0, null, o_orderkey % 300) as nesting_run_id",
        "if(o_orderkey % 4 = 0 and o_orderstatus = 'F', o_orderkey, null) as subscription_id",
        "if(o_orderkey % 11 = 0, cast(o_orderdate as timestamp), null) as superseded_at",
    )
    vat = f"cast({VAT_RATE} as decimal(3,2))"
    return base.selectExpr(
        "*",
        "if(payment_method = 'card_usd', 'usd', 'crc') as currency",
        "amount as list_price",
        "cast(if(id % 6 = 0, 10, 0) as decimal(12,2)) as discount_amount",
        "cast(amount - if(id % 6 = 0, 10, 0) as decimal(12,2)) as subtotal",
        f"cast(round(cast(amount - if(id % 6 = 0, 10, 0) as decimal(12,2)) * {vat}, 2) as decimal(12,2)) as tax_amount",
        "if(id % 7 = 0, cast(0 as decimal(12,2)), cast(round(amount * cast(1.13 as decimal(3,2)), 2) as decimal(12,2)))"
        " as total_amount",
        """case when purpose = 'single_download' then 'single_download'
           else concat('plan_', element_at(array(1,2,4), cast(id % 3 as int) + 1), '_months') end as product_description""",
        "if(status = 'succeeded', created_at + make_dt_interval(0, 0, cast(id % 30 as int), 0), null) as paid_at",
        "concat('Name_', user_id) as purchaser_name",
        "concat('user', user_id, '%', id % 10, '@Example.com') as purchaser_email",
        "if(purpose = 'single_download', lpad(cast(id as string), 12, '0'), null) as purchase_reference",
        "if(payment_method = 'sinpe_crc', concat('ID', user_id), null) as sinpe_transfer_identification",
        "if(payment_method = 'sinpe_crc', concat('8', lpad(cast(user_id as string), 7, '0')), null)"
        " as sinpe_transfer_mobile_number",
        "if(id % 2 = 0, 'onvo', null) as gateway_provider",
        "if(id % 2 = 0 and id % 14 <> 0, concat('pi_', id), null) as onvo_payment_intent_id",
        "if(id % 2 = 0, 'test', null) as onvo_mode",
        """if(id % 2 = 0, case status when 'succeeded' then 'succeeded' when 'failed' then 'requires_payment_method'
           else element_at(array('processing','canceled','requires_action'), cast(id % 3 as int) + 1) end, null)
           as gateway_status""",
        "if(id % 13 = 0, '', if(id % 3 = 0, null, '8314200000100')) as cabys_code",
        "if(id % 19 = 0 and status <> 'succeeded', created_at + interval 5 minutes, null) as checkout_abandoned_at",
        "if(id % 17 = 0 and status = 'pending', created_at + interval 10 minutes, null) as checkout_lock_released_at",
        "if(id % 17 = 0 and status = 'pending', if(id % 2 = 0, 'timeout', 'odd_reason'), null) as checkout_lock_reason",
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey as id",
        "concat('User', c_custkey, '@', lower(c_mktsegment), '.example') as email",
        "c_name as name",
        """case c_nationkey % 3 when 0 then 'America/Costa_Rica' when 1 then 'America/New_York' else 'UTC' end
           as time_zone""",
        "if(c_custkey % 9 = 0, null, timestamp'1994-01-01') as confirmed_at",
        "if(c_custkey % 13 = 0, timestamp'1996-01-01', null) as suspended_at",
    )


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Paid plan purchases as subscriptions ending N months on (UTC day end)."""
    return (
        payments(spark, d)
        .where("purpose = 'plan_subscription' and status = 'succeeded'")
        .selectExpr(
            "id",
            "user_id",
            "cast(regexp_extract(product_description, '^plan_([0-9]+)_months$', 1) as int) as tier_months",
            "created_at as starts_at",
        )
        .withColumn(
            "ends_at",
            F.expr(
                "cast(add_months(to_date(starts_at), tier_months) as timestamp) + interval 1 day - interval 1 microsecond"
            ),
        )
    )


def download_grants(spark: SparkSession, d: str) -> DataFrame:
    """One grant per (user, run) with a paid single download."""
    paid = payments(spark, d).where("purpose = 'single_download' and status = 'succeeded'")
    return (
        paid.groupBy("user_id", "nesting_run_id")
        .agg(
            F.max("id").alias("id"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        )
        .selectExpr(
            "*",
            "if(id % 8 = 1, 'plan_included', 'single_purchase') as kind",
            """if(id % 5 = 0, null, updated_at + make_dt_interval(cast(id % 400 as int), 0, 0, 0))
               as retained_until""",
        )
    )


def downloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id",
        "o_orderkey % 300 as nesting_run_id",
        "cast(o_orderdate as timestamp) + interval 3 days as downloaded_at",
        "o_orderkey % 6 = 0 as via_token",
    )


def carts(spark: SparkSession, d: str) -> DataFrame:
    """User carts (customers in credit) and guest carts (all customers, token g-<key>)."""
    c = table(spark, d, "customer")
    own = c.where("c_acctbal >= 5000").selectExpr(
        "c_custkey * 2 as id", "c_custkey as user_id", "cast(null as string) as guest_token", "c_custkey", "c_nationkey"
    )
    guest = c.selectExpr(
        "c_custkey * 2 + 1 as id",
        "cast(null as bigint) as user_id",
        "concat('g-', c_custkey) as guest_token",
        "c_custkey",
        "c_nationkey",
    )
    return own.unionByName(guest).selectExpr(
        "id",
        "user_id",
        "guest_token",
        "if(c_nationkey % 2 = 0, c_custkey % 300, null) as nesting_run_id",
        "if(c_nationkey % 3 = 0, null, element_at(array(1,2,4), cast(c_custkey % 3 as int) + 1)) as tier_months",
        "if(c_nationkey % 4 = 0, 'usd', 'crc') as currency_mode",
        "cast(1000 + c_custkey % 7 * 100 as bigint) as list_price_cents",
        "cast(1050 + c_custkey % 5 * 100 as bigint) as sinpe_price_cents",
    )


def logins(spark: SparkSession, d: str) -> DataFrame:
    """Which guest token logged in as which user."""
    return table(spark, d, "customer").where("c_mktsegment in ('HOUSEHOLD', 'MACHINERY')").selectExpr(
        "concat('g-', c_custkey) as guest_token", "c_custkey as user_id"
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    created = f"({EPOCH_2024} + (id * 173) % {MONTH_SECONDS})"
    base = table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "o_orderkey % 40 as project_id", "o_custkey", "o_orderstatus"
    )
    return base.selectExpr(
        "id",
        "project_id",
        """case o_orderstatus when 'F' then if(id % 3 = 0, 'partial', 'completed') when 'P' then 'failed'
           else 'processing' end as status""",
        f"timestamp_seconds({created}) as created_at",
        f"if(id % 17 = 0, null, timestamp_seconds({created} + id % 7)) as started_at",
        f"if(o_orderstatus = 'O', null, timestamp_seconds({created} + 7 + o_custkey % 900)) as finished_at",
        f"if(id % 29 = 0, timestamp_seconds({created} + 60), null) as cancel_requested_at",
        "cast(if(id % 5 = 0, 1, 0) as int) as exit_code",
        "id % 23 <> 0 as has_output",
        """named_struct(
             'status', if(id % 41 = 0, 'unknown', if(id % 3 = 0, 'partial', 'completed')),
             'orphans', if(id % 4 = 0, array(), transform(sequence(0, cast(id % 4 as int) - 1), i -> named_struct(
                'piece_index', i, 'piece_key', cast(i as string),
                'reason', if((id + i) % 2 = 0, 'oversized_for_sheet', 'no_sheet_capacity')))),
             'warnings', if(id % 31 = 0, array('cancelled'), array()),
             'sheets_used', if(id % 6 = 0, 2, null),
             'pieces_count', if(id % 6 = 0, 9, null)) as report""",
    )


def placement_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as run_id",
        """transform(sequence(0, cast(o_orderkey % 3 as int)), s -> named_struct(
             'stock_sort_order', s, 'sheet_index', s,
             'width_mm', 700D + 100 * s, 'height_mm', 700D, 'offset_x_mm', (2 - s) * 900D,
             'pieces', if((o_orderkey + s) % 4 = 0, array(),
                transform(sequence(0, cast((o_orderkey + s) % 4 as int) - 1), p -> named_struct(
                  'piece_index', s * 4 + p, 'x_mm', p * 100.5D, 'y_mm', p * 50D, 'rotation_deg', p * 90D,
                  'width_mm', 80D, 'height_mm', 40D, 'primary_layer_name', 'CUT'))))) as sheets""",
    )


def progress(spark: SparkSession, d: str) -> DataFrame:
    return shape_progress(table(spark, d, "events"))


def shape_progress(raw: DataFrame) -> DataFrame:
    """Event rows as progress documents of runs (run = user)."""
    return raw.selectExpr(
        "event_id as id",
        "user_id as run_id",
        "cast(ts as timestamp) as at",
        """to_json(named_struct('version', if(event_id % 10 = 0, 3, if(event_id % 3 = 0, 1, 2)),
             'phase_id', element_at(array('extracting','fill','optimizing','consolidating','refining',
                                          'writing_outputs','bogus'), cast(event_id % 7 as int) + 1),
             'percent', cast(floor(value) as int), 'pieces_total', 40, 'pieces_placed', cast(event_id % 41 as int),
             'eta_sec', cast(event_id % 600 as int))) as doc""",
    )


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles (kind 0), rectangles with a centred hole (1) and L shapes (2) per order."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    # numbered behind the join, as the last step that deals rows: what follows by project finds them dealt
    sized = table(spark, d, "lineitem").join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_orderkey as project_id",
        """cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_shipdate) - 1 as int) as piece_index""",
        "l_quantity * 20 as width_mm",
        "(p_size + 1) * 15D as height_mm",
        "cast(p_size % 3 as int) as kind",
        "l_partkey",
        "l_returnflag as layer",
    )
    return sized.withColumn(
        "rings",
        F.expr(
            """case kind
             when 0 then array(array(array(0D,0D), array(width_mm,0D), array(width_mm,height_mm), array(0D,height_mm)))
             when 1 then array(
               array(array(0D,0D), array(width_mm,0D), array(width_mm,height_mm), array(0D,height_mm)),
               array(array(width_mm/4,height_mm/4), array(width_mm*3/4,height_mm/4),
                     array(width_mm*3/4,height_mm*3/4), array(width_mm/4,height_mm*3/4)))
             else array(array(array(0D,0D), array(width_mm,0D), array(width_mm,height_mm/2),
                  array(width_mm/2,height_mm/2), array(width_mm/2,height_mm), array(0D,height_mm))) end"""
        ),
    )


def stocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "explode(array(0, 1)) as k").selectExpr(
        "o_orderkey * 2 + k as id",
        "o_orderkey as project_id",
        "if(k = 0, 700D, 1220D) as width_mm",
        "if(k = 0, 700D, 1000D) as height_mm",
        "if(k = 1 and o_orderkey % 3 = 0, null, cast(1 + o_orderkey % 3 as int)) as quantity",
        "cast(if(o_orderkey % 2 = 0, k, 1 - k) as int) as sort_order",
    )


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Pieces put on two sheets per run at scattered corners (kept as given, overlaps included)."""
    return pieces(spark, d).selectExpr(
        "project_id as run_id",
        "cast(piece_index % 2 as int) as sheet_index",
        "piece_index",
        "cast((piece_index * 211 + project_id * 17) % 700 as double) as x_mm",
        "cast((piece_index * 131 + project_id * 29) % 500 as double) as y_mm",
        "width_mm",
        "height_mm",
        "kind",
        "rings",
    )


def layers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_partkey as id",
        "p_partkey % 200 as project_id",
        "if(p_partkey % 23 = 0, null, p_partkey % 400) as attachment_id",
        "p_brand as layer_name",
        "if(p_partkey % 5 = 0, null, concat('#', p_size)) as color",
        "case p_size % 3 when 0 then 'primary' when 1 then 'auxiliary' end as layer_role",
        "p_partkey % 4 <> 0 as included",
        "p_partkey % 2 = 0 as auto_close_gaps",
        """if(p_size % 4 = 0, cast(array() as array<struct<distance_mm:double,start:array<double>,end:array<double>>>),
           transform(sequence(1, p_size % 4), i -> named_struct('distance_mm', (p_partkey * i) % 2000 / 100D,
             'start', array(cast(i as double), 0D), 'end', array(i + 1D, 2D)))) as gaps_detected""",
    )


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "o_orderkey % 500 as project_id",
        "cast(o_orderkey div 500 as string) as piece_key",
        "case o_orderstatus when 'F' then 'resolved' when 'O' then 'pending' else 'split_ready' end as resolution_state",
    )


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Split proposals: one per order line, numbered by line within the orphan."""
    return (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_returnflag").alias("flag"))
        .selectExpr(
            "l_orderkey * 16 + l_linenumber as id",
            "l_orderkey as orphan_resolution_id",
            "cast(l_linenumber as int) as version",
            "case flag when 'A' then 'accepted' when 'N' then 'draft' else 'rejected' end as status",
            """transform(sequence(0, l_linenumber % 3), i -> named_struct('label', chr(97 + i),
               'rings', array(array(array(0D, 0D), array(i + 1D, 0D), array(i + 1D, 5D), array(0D, 5D)))))
               as child_piece_geometries""",
            "array(array(array(0D, 1D * l_linenumber), array(9D, 1D * l_linenumber))) as cut_segments",
        )
    )


def derived(spark: SparkSession, d: str) -> DataFrame:
    """Derived pieces already stored for the orphans of urgent orders."""
    return table(spark, d, "orders").where("o_orderpriority like '1%'").selectExpr(
        "o_orderkey as id",
        "o_orderkey % 500 as project_id",
        "cast(o_orderkey div 500 as string) as parent_piece_key",
        "'Pieza-1a' as label",
        "0 as sort_order",
        "array(array(array(0D,0D), array(3D,0D), array(3D,4D), array(0D,4D))) as rings",
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).selectExpr(
        "project_id * 64 + piece_index as id",
        "project_id % 100 as drawing_id",
        "case layer when 'A' then 'CUT' when 'N' then 'MARK' else 'ENGRAVE' end as layer",
        """element_at(array('LWPOLYLINE','CIRCLE','LINE','TEXT','ARC','HATCH','POINT'),
           cast((l_partkey + if(layer = 'A', 0, piece_index)) % if(layer = 'A', 3, 7) as int) + 1) as etype""",
        "cast(power((project_id * 64 + piece_index) % 9973, 2) * 31 % 6007 as double) as min_x",
        "cast(power((project_id * 64 + piece_index) % 7919, 2) * 17 % 6011 as double) as min_y",
        "width_mm / 20 as w",
        "height_mm / 15 as h",
    ).selectExpr("id", "drawing_id", "layer", "etype", "min_x", "min_y", "min_x + w as max_x", "min_y + h as max_y")


def contours(spark: SparkSession, d: str) -> DataFrame:
    """Nested rectangles: pieces of an order shifted by 10 mm per index."""
    return pieces(spark, d).selectExpr(
        "project_id * 64 + piece_index as id",
        "project_id as drawing_id",
        "layer",
        "piece_index * 10D as x0",
        "piece_index * 10D as y0",
        "width_mm",
        "height_mm",
    ).withColumn(
        "rings",
        F.expr(
            """array(array(array(x0,y0), array(x0+width_mm,y0), array(x0+width_mm,y0+height_mm),
               array(x0,y0+height_mm)))"""
        ),
    )


def circles(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).selectExpr(
        "project_id * 64 + piece_index as id",
        "project_id as drawing_id",
        "layer",
        "(piece_index % 2) * 500D + (l_partkey % 3) * 0.5D as cx",
        "(l_partkey % 2) * 0.5D as cy",
        "width_mm / 10 as r",
    )


def ip_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint address ranges with gaps, one per customer."""
    return table(spark, d, "customer").selectExpr(
        "c_custkey * 2000000 as ip_from",
        "c_custkey * 2000000 + 1499999 as ip_to",
        "concat(chr(65 + c_nationkey % 26), chr(65 + (c_nationkey * 7) % 26)) as country_code",
    )


def feedbacks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr(
        "conv_id * 1000 + turn as id",
        "if(conv_id % 3 = 0, null, conv_id) as user_id",
        "element_at(array('suggestion','bug','other','praise'), cast(turn % 4 as int) + 1) as feedback_type",
        "element_at(array('pending','reviewed','archived'), cast(conv_id % 3 as int) + 1) as status",
        "if(turn % 5 = 4, ' ok ', text) as message",
        "if(conv_id % 4 = 0, null, concat(' Conv', conv_id, '@Mail.example ')) as email",
        "timestamp_seconds(1704067200 + conv_id * 60 + turn) as created_at",
    )


def gateway_events(spark: SparkSession, d: str) -> DataFrame:
    """Gateway webhooks derived from order lines; unknown intents included."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('pi_', if(l_linenumber = 7, l_orderkey + 100000000, l_orderkey)) as payment_intent_id",
        """case l_returnflag when 'A' then 'payment-intent.succeeded' when 'R' then 'payment-intent.failed'
           else 'payment-intent.deferred' end as type""",
        "cast(l_shipdate as timestamp) as at",
        "l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as event_no",
    )


def usages(spark: SparkSession, d: str) -> DataFrame:
    """Monthly plan usage: quantities shipped per order and month as downloads, capped by the quota itself."""
    shipped = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("subscription_id"),
        F.expr("year(l_shipdate)").alias("period_year"),
        F.expr("month(l_shipdate)").alias("period_month"),
    )
    return shipped.agg(
        F.expr("cast(least(sum(l_quantity), 50) as int)").alias("downloads_used"),
        F.expr("cast(min(l_shipdate) as timestamp)").alias("created_at"),
    ).withColumn("quota_limit", F.lit(50))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Price requests, some of them illegal combinations."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "if(o_orderkey % 4 = 0, 'plan', 'single_download') as product",
        "if(o_orderkey % 9 = 0, null, element_at(array(1,2,4,3), cast(o_orderkey div 4 % 4 as int) + 1)) as tier_months",
        "o_orderkey % 5 = 0 as overage",
        "if(o_orderkey % 3 = 0, 'usd', 'crc') as currency",
        "if(o_orderkey % 2 = 0, 'sinpe', 'card') as billing_method",
        "o_orderkey % 3 <> 0 as iva_applicable",
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Requests with every hint of the visitor's country."""
    return user_events(spark, d).selectExpr(
        "id",
        "ip",
        "if(id % 4 = 0, ' cr', if(id % 7 = 0, ' ', null)) as header_country",
        "case when user_id % 3 = 0 then 'America/Costa_Rica' when user_id % 3 = 1 then 'UTC' end as time_zone",
        "if(id % 3 = 0, 'US', null) as session_country",
    )


def projects(spark: SparkSession, d: str) -> DataFrame:
    """One project per order, with some values out of range."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "if(o_orderkey % 43 = 0, ' ', concat('Order ', o_orderkey)) as title",
        "o_custkey % 5 - 1D as kerf_mm",
        "5D as margin_mm",
        "if(o_orderkey % 12 = 0, 0D, 0.1D) as curve_tolerance_mm",
        "15D as sheet_gap_mm",
        "600 as nesting_time_limit_sec",
        "'draft' as status",
    )


def layer_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Closed contours per layer: the order lines of the part that were returned."""
    return (
        table(spark, d, "lineitem")
        .where("l_returnflag = 'A'")
        .groupBy(F.col("l_partkey").alias("layer_id"))
        .agg(F.count("*").alias("n_pieces"))
    )


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as an upload manifest: odd pages get a drawing's extension, every third a drawing's head."""
    return table(spark, d, "pages").selectExpr(
        "page_id as id",
        "if(page_id % 2 = 0, concat(url, '.DXF'), url) as path",
        "encode(if(page_id % 3 = 0, concat('0 SECTION ', html), html), 'UTF-8') as content",
    ).selectExpr("*", "cast(length(content) as bigint) * if(id % 50 = 0, 100000, 1) as length")


def blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id as id", "source as filename", "n_chars as byte_size")


def attachments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("doc_id as id", "doc_id as blob_id")


def plates(spark: SparkSession, d: str) -> DataFrame:
    """Pieces side by side in one drawing per order, each holed one with a rectangle in its hole."""
    base = pieces(spark, d).selectExpr(
        "project_id", "piece_index", "kind", "layer", "width_mm as w", "height_mm as h", "piece_index * 2000D as x0",
        "element_at(array(0.5D, 1D, 1.2D), cast(l_partkey % 3 as int) + 1) as f", "rings",
    )
    own = base.selectExpr(
        "project_id * 128 + piece_index * 2 as id",
        "project_id as drawing_id",
        "layer",
        "transform(rings, r -> transform(r, p -> array(p[0] + x0, p[1]))) as rings",
    )
    fill = base.where("kind = 1").selectExpr(
        "project_id * 128 + piece_index * 2 + 1 as id",
        "project_id as drawing_id",
        "layer",
        """array(array(array(x0 + w/2 - f*w/4, h/2 - f*h/4), array(x0 + w/2 + f*w/4, h/2 - f*h/4),
           array(x0 + w/2 + f*w/4, h/2 + f*h/4), array(x0 + w/2 - f*w/4, h/2 + f*h/4))) as rings""",
    )
    return own.unionByName(fill)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Decoration segments: a horizontal one per order line, with repeats."""
    return pieces(spark, d).selectExpr(
        "project_id * 64 + piece_index as id",
        "project_id",
        "array(array(-10D, (l_partkey % 4) * 100 + 50.5D), array((l_partkey % 3 + 1) * 200D + 0.00001D * piece_index, (l_partkey % 4) * 100 + 50.5D)) as points",
    )


def gap_ends(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the stored layers as rows."""
    return layers(spark, d).select("id", "project_id", "layer_name", F.posexplode("gaps_detected").alias("no", "gap")).selectExpr(
        "id * 8 + no as id", "project_id as drawing_id", "layer_name as layer", "gap.start as start", "gap.end as end"
    )


def open_polylines(spark: SparkSession, d: str) -> DataFrame:
    """One open polyline per layer, its ends close to where a first or second gap would lie."""
    return layers(spark, d).selectExpr(
        "id",
        "project_id as drawing_id",
        "layer_name as layer",
        """if(id % 2 = 0, array(array(1.6D, 0.3D), array(9D, 9D), array(2.5D, 1.5D)),
           array(array(3.2D, 2.9D), array(9D, 9D), array(1.1D, 0.5D))) as points""",
    )
