"""The retail star schema as the operators' source tables."""

PLACES = (
    "['CUN','RIO','BUE','MIA','MAD','SCL','BOG','LIM','GRU','IGU','CHI','VER','BRC',"
    "'PUJ','MEX','LAX','NYC','REC','FLN','COR','QQQ','ZZZ','XYZ','SSA','PVR']"
)

CTES = {
    "lines": """
        SELECT l.*, o.*,
            l_orderkey::VARCHAR || '-' || l_returnflag AS transaction_code,
            o_custkey::VARCHAR AS social_id,
            o_orderdate::DATE AS reservation_date,
            o_orderdate + to_hours(l_linenumber) AS reservation_datetime,
            strftime(o_orderdate, '%Y-%m') AS reservation_year_month,
            CASE o_orderstatus WHEN 'F' THEN 'Confirmado' WHEN 'O' THEN 'Pendiente' WHEN 'P' THEN 'Cancelado' END AS status,
            l_extendedprice * (1 - l_discount) AS price
        FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey""",
    "placed": """
        SELECT lines.*, c.*, s.s_nationkey, b.n_name AS buyer_nation,
            b.n_regionkey AS buyer_region, v.n_regionkey AS seller_region
        FROM lines JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
        JOIN nation b ON b.n_nationkey = c.c_nationkey JOIN nation v ON v.n_nationkey = s.s_nationkey""",
    "src_transactions": """
        SELECT transaction_code, social_id, reservation_date, reservation_datetime, reservation_year_month,
            CASE WHEN l_linestatus = 'F' THEN 'APP' ELSE o_orderpriority END AS platform,
            CASE WHEN l_quantity <= 40 THEN c_mktsegment END AS parent_channel,
            CASE WHEN buyer_region = seller_region THEN 'Nac' ELSE 'Int' END AS trip_type,
            'House' AS brand, 'B2C' AS line_of_business, status AS transaction_status,
            price AS gross_bookings_usd, l_extendedprice * 0.8::DOUBLE AS cost_usd,
            price * (l_tax - 0.02::DOUBLE) AS margin_variable_without_mkt_net_usd,
            price * l_tax AS net_revenues_usd, price * (l_tax - l_discount) AS npv_without_mkt_net_usd,
            l_quantity AS fee_net_usd
        FROM placed""",
    "src_trips": f"""
        SELECT social_id, l_orderkey::VARCHAR AS trip_id, transaction_code, reservation_datetime, reservation_date,
            reservation_year_month, status AS trip_status, status AS transaction_status, 'House' AS brand,
            CASE l_returnflag WHEN 'A' THEN 'Vuelos' WHEN 'N' THEN 'Hoteles' WHEN 'R' THEN 'Carrito' END AS purchase_type,
            CASE p_type WHEN 'STANDARD' THEN 'Vuelos' WHEN 'MEDIUM' THEN 'Hoteles' WHEN 'PROMO' THEN 'Traslados'
                WHEN 'ECONOMY' THEN 'Autos' WHEN 'LARGE' THEN 'Asistencia al viajero' WHEN 'SMALL' THEN 'Actividades' END AS product_type,
            buyer_nation AS country_code,
            CASE WHEN p_type = 'STANDARD' THEN {PLACES}[c_nationkey + 1] END AS first_origin_id,
            CASE WHEN l_tax < 0.08 THEN {PLACES}[s_nationkey + 1] END AS first_destination_id,
            min(l_shipdate) OVER (PARTITION BY l_orderkey) AS trip_checkin,
            max(l_shipdate) OVER (PARTITION BY l_orderkey) AS trip_checkout
        FROM placed JOIN part ON l_partkey = p_partkey""",
    "src_visits": """
        SELECT user_id::VARCHAR AS social_id, event_id::VARCHAR AS visit_id, start_visit,
            strftime(start_visit, '%Y-%m-%d') AS visit_date,
            TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS count_search,
            CASE WHEN event_type = 'error' THEN 'Other' ELSE ' house ' END AS company,
            CASE event_type WHEN 'view' THEN 'iphone-app' WHEN 'click' THEN 'android-app' ELSE 'web' END AS main_channel
        FROM (SELECT *, TIMESTAMP '1995-01-01' + to_microseconds(80 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))) AS start_visit
              FROM events)""",
    "src_attribution": """
        SELECT transaction_code AS transaction_id, reservation_date,
            CASE WHEN l_linestatus = 'F'
                THEN ['PUSH','SEM_WHATSAPP','SEO_GOOGLE_HOTELS','SEOAX','SEM_GENERIC','MANUAL_ENTRY',NULL][l_linenumber]
                ELSE ['MANUAL_ENTRY','EMAIL','SEM_KAYAK','SEO_BRAND','BND_CORE','ERROR_SEM_X','DISPLAY_ADS'][l_linenumber] END AS event_type,
            l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS event_id,
            CASE WHEN l_discount = 0 THEN 'not a date'
                ELSE strftime(l_shipdate + to_hours(l_linenumber), '%Y-%m-%d %H:%M:%S') END AS click_date_time,
            CASE WHEN l_tax = 0.08 THEN 34 ELSE 33 END AS model_id
        FROM lines""",
    "src_segments": """
        SELECT transaction_code, reservation_year_month,
            CASE WHEN p_size <= 25 THEN 'ECONOMY' WHEN p_size <= 35 THEN 'PREMIUM_ECONOMY'
                WHEN p_size <= 45 THEN 'BUSINESS' WHEN p_size <= 48 THEN 'FIRST' END AS flight_class
        FROM lines JOIN part ON l_partkey = p_partkey""",
    "src_discounts": """
        SELECT transaction_code, reservation_date, reservation_year_month,
            CASE WHEN l_discount > 0.07 THEN 'SAVE' ELSE ' ' END AS coupon_code,
            CASE WHEN l_discount = 0.02 THEN 'U' END AS coupon_use_id
        FROM lines""",
    "src_products": """
        SELECT transaction_code, reservation_year_month,
            CASE p_type WHEN 'STANDARD' THEN 'Vuelos' WHEN 'MEDIUM' THEN 'Hoteles' WHEN 'PROMO' THEN 'Traslados'
                WHEN 'ECONOMY' THEN 'Autos' WHEN 'LARGE' THEN 'Asistencia al viajero' WHEN 'SMALL' THEN 'Actividades' END AS product_type,
            CASE WHEN l_tax > 0 THEN (l_quantity % 3 + 1)::INTEGER END AS adults_quantity,
            CASE WHEN l_tax > 0 THEN (l_discount >= 0.09)::INTEGER END AS childs_quantity,
            CASE WHEN l_tax > 0 THEN (l_quantity >= 48)::INTEGER END AS infants_quantity,
            CASE WHEN l_tax > 0 THEN (l_quantity % 3 + 1)::INTEGER + (l_discount >= 0.09)::INTEGER
                + (l_quantity >= 48)::INTEGER END AS total_passengers_quantity
        FROM lines JOIN part ON l_partkey = p_partkey""",
    "src_redemptions": """
        SELECT transaction_code AS redeemed_transaction_code,
            CASE WHEN l_quantity > 5 THEN l_quantity * 10 END AS puntos_redimidos,
            ['1-Viajero',' 2-Explorador','3-Global',''][l_linenumber % 4 + 1] AS tier,
            (l_tax = 0.08)::INTEGER AS flg_cancelado, (l_discount = 0.1)::INTEGER AS flg_error
        FROM lines WHERE l_tax >= 0.05""",
    "src_contacts": """
        SELECT transaction_code, l_suppkey::VARCHAR AS conversation_id,
            ['Satisfecho','Neutro','Insatisfecho','NA'][l_linenumber % 4 + 1] AS nps,
            CASE WHEN l_linestatus = 'F' THEN 'Si' ELSE 'No' END AS resolution,
            CASE WHEN l_quantity > 45 THEN 'n/a' ELSE l_quantity::INTEGER::VARCHAR END AS agent_empathy
        FROM lines WHERE l_returnflag = 'R'""",
    "src_payments": """
        SELECT transaction_code, social_id, reservation_year_month, l_linenumber::VARCHAR AS payment_method_id,
            social_id || '-' || (l_linenumber % 3)::VARCHAR AS payment_user_id,
            CASE WHEN l_discount < 0.1 THEN price END AS gross_bookings_usd
        FROM lines""",
    "src_payment_instruments": """
        SELECT c_custkey::VARCHAR || '-' || slot::VARCHAR AS payment_user_id, c_custkey::VARCHAR AS social_id,
            ['Tarjeta de Crédito','Transferencia','Depósito Bancario','Puntos Loyalty','Cupón','Cash',NULL][(c_nationkey + slot) % 7 + 1] AS payment_type,
            ['Banco Uno','Banco Dos',' ',NULL,'Banco Tres'][(c_nationkey + slot) % 5 + 1] AS bank,
            CASE WHEN c_acctbal > 5000 THEN 'Black' WHEN c_acctbal > 0 THEN 'Gold' ELSE '' END AS tier
        FROM customer, (VALUES (0), (1), (2)) slots(slot)""",
    "src_profiles": f"""
        SELECT o_custkey::VARCHAR AS social_id, o_orderdate AS audit_datetime,
            o_orderdate::DATE - floor(o_totalprice / 100)::INTEGER AS creation_date,
            CASE WHEN o_totalprice > 20000 THEN (1880 + floor(o_totalprice / 4000))::INTEGER END AS birth_year,
            CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_acctbal < 3000 THEN 'Low' WHEN c_acctbal < 6000 THEN 'Medium'
                WHEN c_acctbal < 9000 THEN 'High' ELSE 'Unknown' END AS income,
            CASE WHEN o_orderpriority <> '5-LOW' THEN n_name ELSE ' ' END AS nationality,
            n_name AS country_code,
            CASE WHEN o_orderpriority <> '5-LOW' THEN c_nationkey::VARCHAR ELSE ' ' END AS state_code,
            'State ' || c_nationkey::VARCHAR AS state_name,
            c_mktsegment AS city_id,
            CASE WHEN o_orderpriority <> '5-LOW' THEN c_mktsegment ELSE ' ' END AS city_code,
            c_mktsegment[1] || lower(c_mktsegment[2:]) AS city_name,
            {PLACES}[c_nationkey + 1] AS last_visit_geolocation_city_code,
            n_name AS last_visit_geolocation_country_code,
            CASE WHEN o_orderpriority <> '5-LOW' THEN {PLACES}[c_nationkey + 1] ELSE ' ' END AS frequent_visit_geolocation_city_code,
            CASE WHEN o_orderpriority <> '5-LOW' THEN n_name ELSE ' ' END AS frequent_visit_geolocation_country_code,
            {PLACES}[c_nationkey + 1] AS last_transaction_geolocation_city_code,
            n_name AS last_transaction_geolocation_country_code,
            'House' AS company
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
}
