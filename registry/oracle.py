"""SQL that gives the result of every registered query on the same tables."""

from __future__ import annotations

import re

# Shared tables; a query or another table pulls in the ones it names.
SHARED = {
    "m_malls": """
        SELECT s_suppkey, s_name AS shop_name, r_name AS mall_name, n_name AS mall_city_name,
          'Dealer ' || CAST(s_suppkey - CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE 0 END AS VARCHAR)
            AS partner_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey""",
    "m_sales": """
        SELECT CAST(l_orderkey AS VARCHAR) AS ordr_id, CAST(o_orderdate AS DATE) AS date_id,
          o_orderdate AS ordr_date, strftime(o_orderdate, '%Y-%m') AS month_id,
          mall_name, mall_city_name, p_name AS prod_name, CAST(l_suppkey AS VARCHAR) AS shop_id,
          shop_name,
          CASE WHEN l_quantity >= 49 THEN NULL ELSE 'B' || CAST(l_partkey // 2 AS VARCHAR) END AS booth_id,
          CASE WHEN l_quantity < 5 THEN NULL ELSE 'H' || CAST(l_partkey // 2 AS VARCHAR) END AS house_no,
          lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS partner_code, partner_name,
          CAST(o_custkey AS VARCHAR) AS cust_name, CAST(o_custkey AS VARCHAR) AS mobile,
          lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS contract_code,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS act_amt,
          CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS trade_amt,
          CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS cont_unit_price,
          CASE WHEN l_linestatus = 'F' THEN 'OMS' ELSE 'POS' END AS type,
          CASE WHEN o_orderstatus = 'F' THEN '3' WHEN o_orderstatus = 'P' THEN '15'
               WHEN l_returnflag = 'R' THEN 'X' ELSE 'Y' END AS ordr_status,
          p_type AS cont_cat1_name, p_type || '-' || CAST(p_size % 4 AS VARCHAR) AS cont_cat2_name,
          p_name AS cont_cat3_name, p_brand AS cont_main_brand_name, l_linenumber, l_partkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
          JOIN m_malls ON l_suppkey = s_suppkey""",
    "m_valid": """
        SELECT * FROM m_sales WHERE act_amt > 0 AND ordr_status NOT IN ('1', '7', '19', 'Z', 'X')""",
    "m_dirty": """
        SELECT * REPLACE (
          CASE WHEN l_linenumber = 7 THEN '' ELSE contract_code END AS contract_code,
          CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 5 THEN ' ' ELSE cont_cat1_name END AS cont_cat1_name,
          CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 5 THEN ' ' ELSE cont_cat2_name END AS cont_cat2_name,
          CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 5 THEN ' ' ELSE cont_cat3_name END AS cont_cat3_name)
        FROM m_sales""",
    "m_contracts": """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS contract_code, r_name AS mall_name,
          p_brand AS brand_name, p_name AS series_name,
          'B' || CAST(p_partkey // 2 AS VARCHAR) AS booth_code,
          substr('ABCD', p_size % 4 + 1, 1) AS booth_grade,
          'N' || CAST(p_partkey // 2 AS VARCHAR) || CASE WHEN p_partkey % 9 = 0
            THEN '/N' || CAST(p_partkey // 2 + 1 AS VARCHAR) ELSE '' END AS booth_name,
          CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 6 THEN ' ' ELSE p_type END AS category_name_1,
          CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 6 THEN ' '
            ELSE p_type || '-' || CAST(p_size % 4 AS VARCHAR) END AS category_name_2,
          CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 6 THEN ' ' ELSE p_name END AS category_name_3,
          CAST(p_partkey % 7 + 1 AS VARCHAR) || 'F' AS floor_name,
          CAST(p_size AS DOUBLE) * 1.5 AS rentable_area,
          CASE WHEN p_type = 'ECONOMY' AND p_size = 50 THEN NULL ELSE p_size * CAST(1.7321 AS DOUBLE) END AS actual_area,
          p_retailprice AS zx_price, p_retailprice * 30 AS month_amount,
          DATE '1995-01-01' + CAST(p_partkey * 37 % 1500 AS INTEGER) AS begin_date,
          DATE '1995-01-01' + CAST(p_partkey * 37 % 1500 + 365 + p_partkey * 53 % 1500 AS INTEGER) AS finish_date
        FROM part JOIN region ON p_partkey % 5 = r_regionkey""",
    "m_leases": """
        SELECT c.*, finish_date - begin_date AS contract_duration,
          COALESCE(CASE WHEN regexp_matches(category_name_2, '^ECONOMY-3$') THEN 'ECONOMY special'
                   ELSE category_2_edit END, category_name_2) AS category_2_edit
        FROM m_contracts c LEFT JOIN (
          SELECT DISTINCT p_type || '-' || CAST(p_size % 4 AS VARCHAR) AS category_name_2,
            CASE WHEN p_size % 4 <= 1 THEN p_type || ' basic' END AS category_2_edit
          FROM part) d USING (category_name_2)""",
    "m_joined": """
        SELECT s.*, c.* EXCLUDE (contract_code, mall_name, category_name_1, category_name_2, category_name_3),
          CASE WHEN trim(c.category_name_1) = '' OR c.category_name_1 IS NULL THEN s.cont_cat1_name ELSE c.category_name_1 END AS category_name_1,
          CASE WHEN trim(c.category_name_1) = '' OR c.category_name_1 IS NULL THEN s.cont_cat2_name ELSE c.category_name_2 END AS category_name_2,
          CASE WHEN trim(c.category_name_1) = '' OR c.category_name_1 IS NULL THEN s.cont_cat3_name ELSE c.category_name_3 END AS category_name_3
        FROM m_valid s LEFT JOIN m_leases c USING (contract_code)""",
    "m_promo": """
        SELECT DISTINCT b AS begin_date, e AS end_date FROM (
          SELECT DATE '1996-01-01' + n_nationkey * 60 AS b,
            DATE '1996-01-01' + n_nationkey * 60 + n_nationkey % 20 AS e
          FROM nation WHERE n_nationkey <> 24) WHERE e - b < 15""",
    "m_stall_month": """
        SELECT month_id, category_name_3, floor_name, booth_code, booth_name, booth_grade, house_no,
          shop_name, shop_id, brand_name, series_name, contract_code, contract_duration,
          begin_date, finish_date, CAST(sum(act_amt) AS DOUBLE) / actual_area AS saleperarea,
          CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS order_num
        FROM m_joined
        GROUP BY month_id, category_name_3, floor_name, booth_code, booth_name, booth_grade, house_no,
          shop_name, shop_id, brand_name, series_name, contract_code, contract_duration,
          begin_date, finish_date, actual_area""",
    "m_stall_sum": """
        WITH r AS (SELECT * FROM m_stall_month WHERE month_id >= '1998-01'),
        base AS (
          SELECT booth_code, booth_grade, contract_code, begin_date, finish_date,
            CASE WHEN count(*) = count(saleperarea) THEN sum(saleperarea) END AS saleperarea,
            max(series_name) AS series_name, max(brand_name) AS brand_name
          FROM r GROUP BY ALL),
        cat AS (
          SELECT contract_code, category_name_3 FROM (
            SELECT contract_code, category_name_3, row_number() OVER (
              PARTITION BY contract_code ORDER BY count(*) DESC, category_name_3) AS k
            FROM r WHERE category_name_3 IS NOT NULL GROUP BY contract_code, category_name_3)
          WHERE k = 1)
        SELECT booth_code, booth_grade, contract_code, begin_date, finish_date, saleperarea,
          series_name, category_name_3, brand_name,
          LEAST(DATE '1999-06-30', finish_date) - begin_date AS time_span,
          saleperarea / NULLIF(LEAST(DATE '1999-06-30', finish_date) - begin_date, 0) AS saleperareaperduration
        FROM base LEFT JOIN cat USING (contract_code) WHERE saleperarea IS NOT NULL""",
    "m_stalls": """
        WITH q AS (
          SELECT quantile_cont(saleperarea, [0, .125, .25, .375, .5, .625, .75, .875, 1]) AS a,
            quantile_cont(saleperareaperduration, [0, .125, .25, .375, .5, .625, .75, .875, 1]) AS b
          FROM m_stall_sum)
        SELECT s.*, NULLIF({}, 0) AS saleperareainterval, NULLIF({}, 0) AS saleperareaperdurationinterval
        FROM m_stall_sum s, q""".format(
        *[
            " + ".join(f"CAST({v} > q.{a}[{i}] AS BIGINT)" for i in range(1, 10))
            for a, v in (("a", "saleperarea"), ("b", "saleperareaperduration"))
        ]
    ),
    "m_split_month": """
        SELECT x.* EXCLUDE (booth_code, part), code AS booth_code
        FROM (SELECT *, unnest(string_split(booth_code, '/')) AS part FROM (
                SELECT * REPLACE (replace(booth_name, 'N', 'B') AS booth_code) FROM m_stall_month)) x
        LEFT JOIN (SELECT DISTINCT replace(n, 'N', 'B') AS code, n AS booth_name FROM (
                SELECT unnest(string_split(booth_name, '/')) AS n FROM m_stall_month)) USING (booth_name)""",
    "m_totals": """
        SELECT partner_code, CAST(count(act_amt) AS BIGINT) AS freq,
          CAST(sum(act_amt) AS DOUBLE) / 10000 AS sum_act_amt, max(partner_name) AS partner_name
        FROM m_sales GROUP BY partner_code""",
    "m_survey": """
        SELECT recorded / 10000 * (5 + k % 16) / 10 AS mall_sale_estimated,
          recorded / 10000 * (5 + k % 16) / 5 AS total_sale_estimated,
          CASE WHEN k % 2 = 0 THEN partner_name ELSE 'none' END AS partner_name,
          lpad(CAST(k + k % 3 * 1000000 AS VARCHAR), 10, '0') AS partner_code,
          CASE WHEN k % 5 = 0 THEN partner_name END AS contact_name
        FROM (SELECT CAST(partner_code AS BIGINT) AS k, partner_name, CAST(sum(act_amt) AS DOUBLE) AS recorded
              FROM m_sales GROUP BY partner_code, partner_name)""",
    "m_labelled": """
        SELECT partner_code, freq, sum_act_amt, t.partner_name, mall_sale_estimated, total_sale_estimated,
          CAST(CASE WHEN round(mall_sale_estimated / sum_act_amt, 9) > 1 THEN 1
               WHEN round(mall_sale_estimated / sum_act_amt, 9) = 1 THEN 0 ELSE -1 END AS BIGINT) AS relation_record_estimate,
          mall_sale_estimated / sum_act_amt AS relation_record_estimate_value,
          CAST(CASE WHEN round(mall_sale_estimated / sum_act_amt, 9) <= 1.8
                AND round(mall_sale_estimated / sum_act_amt, 9) > 0.8 THEN 1 ELSE 0 END AS BIGINT) AS relation_record_estimate_real
        FROM m_totals t JOIN m_survey s USING (partner_code)""",
    "m_event_orders": """
        SELECT event_id, CAST(event_id AS VARCHAR) AS ordr_id,
          lpad(CAST(user_id // 15 AS VARCHAR), 10, '0') AS partner_code, CAST(ts AS DATE) AS date_id,
          ts AS ordr_date, epoch_us(ts) AS us, CAST(value AS DECIMAL(18,2)) AS act_amt,
          CASE WHEN value < 2 THEN NULL ELSE 'B' || CAST(user_id % 30 AS VARCHAR) END AS booth_id,
          CAST(user_id AS VARCHAR) AS cust_name,
          CASE WHEN value > 200 THEN NULL ELSE event_type END AS cont_cat3_name,
          CASE WHEN value < 5 THEN NULL ELSE 'H' END AS house_no,
          CASE WHEN value > 100 THEN NULL ELSE value END AS cont_unit_price,
          CASE event_type WHEN 'click' THEN '3' WHEN 'view' THEN '15' WHEN 'purchase' THEN 'Y'
            WHEN 'error' THEN '7' ELSE 'N' END AS ordr_status
        FROM events""",
    "m_gaps": """
        SELECT partner_code, event_id, us, (us - lag(us) OVER w) / 1e6 AS gap, (lead(us) OVER w - us) / 1e6 AS next_gap
        FROM m_event_orders WINDOW w AS (PARTITION BY partner_code ORDER BY us, event_id)""",
    "m_gap_stats": """
        SELECT partner_code, avg(CASE WHEN gap % 86400 = 0 THEN 1.0 ELSE 0.0 END) AS reg_time_perc,
          min(gap) AS min_time_space, COALESCE(min(gap) FILTER (WHERE gap > 0), 86400.0) AS min_time_space_nonzero
        FROM m_gaps WHERE gap IS NOT NULL GROUP BY partner_code""",
    "m_runs": """
        SELECT partner_code, max(a) AS max_cont_hit, max(b) AS max_cont_hit_nozero FROM (
          SELECT partner_code, ia, sum(CASE WHEN gap < 300 THEN 1 ELSE 0 END) OVER (PARTITION BY partner_code, ia) AS a,
            sum(CASE WHEN gap < 300 AND gap <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY partner_code, ib) AS b
          FROM (SELECT *, sum(CASE WHEN gap < 300 THEN 0 ELSE 1 END) OVER w AS ia,
                  sum(CASE WHEN gap < 300 AND gap <> 0 THEN 0 ELSE 1 END) OVER w AS ib
                FROM m_gaps WHERE gap IS NOT NULL
                WINDOW w AS (PARTITION BY partner_code ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)))
        GROUP BY partner_code""",
    "m_isolated": """
        SELECT partner_code, count(*) FILTER (WHERE COALESCE(gap, 1000) > 300 AND COALESCE(next_gap, 1000) > 300) AS isolated,
          count(*) AS orders FROM m_gaps GROUP BY partner_code HAVING count(*) > 1""",
    "m_entropy_events": """
        SELECT partner_code, count(*) AS category_num, sum(-p * ln(p)) / count(*) AS cust_entropy FROM (
          SELECT partner_code, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY partner_code) AS p
          FROM m_event_orders GROUP BY partner_code, cust_name) GROUP BY partner_code""",
    "m_top3_events": """
        SELECT partner_code, cont_cat3_name, c * 1.0 / s AS cat3_perc_value FROM (
          SELECT partner_code, cont_cat3_name, count(*) AS c, sum(count(*)) OVER (PARTITION BY partner_code) AS s,
            row_number() OVER (PARTITION BY partner_code ORDER BY count(*) DESC, min(ordr_date), cont_cat3_name) AS k
          FROM m_event_orders GROUP BY partner_code, cont_cat3_name) WHERE k = 1""",
    "m_features": """
        SELECT f.*, reg_time_perc, min_time_space, min_time_space_nonzero, max_cont_hit, max_cont_hit_nozero,
          isolated * 1.0 / orders AS isolated_perc, over_500_sum, below_500_sum,
          over_500_sum * 1.0 / (over_500_sum + below_500_sum) AS big_sale_percentage, num_booth,
          category_num, cust_entropy, cont_cat3_name, cat3_perc_value, missing_house_no, missing_cont_unit_price,
          "1", "12", "14", "15", "17", "19", "3", "7", "Y"
        FROM (SELECT partner_code, max(c) AS max_freq_in_day FROM (
                SELECT partner_code, date_id, count(*) AS c FROM m_event_orders GROUP BY ALL) GROUP BY partner_code) f
          LEFT JOIN m_gap_stats USING (partner_code) LEFT JOIN m_runs USING (partner_code)
          LEFT JOIN m_isolated USING (partner_code)
          LEFT JOIN (SELECT partner_code, count(*) FILTER (WHERE act_amt > 500) AS over_500_sum,
              count(*) FILTER (WHERE act_amt <= 500) AS below_500_sum,
              count(DISTINCT booth_id) + max(CASE WHEN booth_id IS NULL THEN 1 ELSE 0 END) AS num_booth,
              avg(CASE WHEN house_no IS NULL THEN 1.0 ELSE 0.0 END) AS missing_house_no,
              avg(CASE WHEN cont_unit_price IS NULL THEN 1.0 ELSE 0.0 END) AS missing_cont_unit_price,
              NULL::DOUBLE AS "1", NULL::DOUBLE AS "12", NULL::DOUBLE AS "14", NULL::DOUBLE AS "17", NULL::DOUBLE AS "19",
              NULLIF(count(*) FILTER (WHERE ordr_status = '15'), 0) * 1.0 / count(*) AS "15",
              NULLIF(count(*) FILTER (WHERE ordr_status = '3'), 0) * 1.0 / count(*) AS "3",
              NULLIF(count(*) FILTER (WHERE ordr_status = '7'), 0) * 1.0 / count(*) AS "7",
              NULLIF(count(*) FILTER (WHERE ordr_status = 'Y'), 0) * 1.0 / count(*) AS "Y"
            FROM m_event_orders GROUP BY partner_code) USING (partner_code)
          LEFT JOIN m_entropy_events USING (partner_code) LEFT JOIN m_top3_events USING (partner_code)""",
    "m_track": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS profile_id, user_id,
          CAST(user_id AS VARCHAR) AS pid, CAST(user_id // 5 AS VARCHAR) AS store_id,
          'Shop ' || CAST((user_id + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) // 5 AS VARCHAR) AS store_name,
          CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS event_type,
          CAST(ts AS DATE) AS enter_date, strftime(ts, '%Y%m%d') AS dt, CAST(ts AS TIMESTAMP) AS enter_time,
          CAST(ts AS TIMESTAMP) + to_microseconds(CAST(CAST(value AS DECIMAL(18,2)) * 60000000 AS BIGINT)) AS exit_time,
          CAST(CAST(value AS DECIMAL(18,2)) * 60000000 AS BIGINT) AS stay_us
        FROM events""",
    "m_profiles": """
        SELECT DISTINCT CAST(user_id AS VARCHAR) AS rs_profile_id, 1 AS is_valid,
          CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS is_staff FROM events""",
    "m_visits": """
        SELECT *, stay_us / 6e7 AS duration FROM m_track
        WHERE event_type = 0 AND profile_id NOT IN (
          SELECT rs_profile_id FROM m_profiles WHERE is_valid = 1 AND is_staff = 1)""",
    "m_shop_orders": """
        SELECT CAST(event_id AS VARCHAR) AS ordr_id, CAST(user_id // 5 AS VARCHAR) AS shop_id,
          CAST(ts AS DATE) AS date_id, CAST(ts AS TIMESTAMP) AS ordr_date, CAST(value AS DECIMAL(18,2)) AS act_amt,
          'P' || CAST(user_id % 5 AS VARCHAR) AS prod_name, 'C' || CAST(user_id % 3 AS VARCHAR) AS cont_cat3_name,
          'M' || CAST(user_id % 2 AS VARCHAR) AS cont_main_brand_name
        FROM events WHERE event_type = 'purchase'""",
    "m_pairs": """
        SELECT o.*, v.id AS visit_id, v.profile_id, v.enter_time, v.exit_time, v.stay_us, v.duration,
          CASE WHEN o.ordr_date BETWEEN v.enter_time AND v.exit_time THEN 1 ELSE 0 END AS person_related
        FROM m_shop_orders o JOIN m_visits v ON o.shop_id = v.store_id AND o.date_id = v.enter_date""",
    "m_related": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY enter_time
            ORDER BY shop_id, date_id, ordr_date, ordr_id, profile_id, exit_time) AS k FROM m_pairs)
        WHERE k = 1 AND person_related = 1""",
    "m_traffic": """
        SELECT store_id AS shop_id, week(enter_date) AS period, count(DISTINCT (enter_date, profile_id)) AS total_uv,
          count(DISTINCT enter_time) AS total_pv, median(stay_us) / 6e7 AS median_duration, avg(stay_us) / 6e7 AS avg_duration
        FROM m_visits GROUP BY ALL""",
    "m_related_traffic": """
        SELECT shop_id, week(date_id) AS period, count(DISTINCT profile_id) AS total_related_uv, count(*) AS total_related_pv,
          median(stay_us) / 6e7 AS median_related_duration, avg(stay_us) / 6e7 AS avg_related_duration
        FROM m_related GROUP BY ALL""",
    "m_order_num": """
        SELECT shop_id, cont_cat3_name, cont_main_brand_name, week(date_id) AS period, count(*) AS order_num
        FROM m_shop_orders GROUP BY ALL""",
    "m_uv": """
        SELECT store_id, count(DISTINCT pid) AS month_uv,
          count(DISTINCT CASE WHEN stay_us > 120000000 THEN dt || '/' || pid END) AS month_daily_uv
        FROM m_track WHERE event_type = 0 GROUP BY store_id""",
    "m_booths": """
        SELECT booth_code, shop_id, min(shop_name) AS shop_name FROM (
          SELECT 'B' || CAST(p_partkey // 2 AS VARCHAR) AS booth_code, CAST(p_partkey // 66 AS VARCHAR) AS shop_id, p_name AS shop_name
          FROM part) GROUP BY ALL""",
    "m_booth_uv": """
        SELECT booth_code, store_id, month_uv, month_daily_uv, shop_name, contract_code
        FROM m_uv LEFT JOIN m_booths ON store_id = shop_id
          LEFT JOIN (SELECT booth_code, contract_code FROM m_contracts) USING (booth_code)""",
    "m_layout": """
        SELECT CAST(p_partkey % 7 + 1 AS VARCHAR) || 'F' AS floor, p_partkey // 7 % 15 + 1 AS row, p_partkey // 105 + 1 AS col,
          CASE WHEN p_size = 1 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS contract_code
        FROM part""",
    "m_grid": """
        SELECT l.*, booth_code FROM m_layout l LEFT JOIN (
          SELECT contract_code, booth_code FROM m_contracts) USING (contract_code)""",
    "m_ratios": """
        SELECT t.shop_id, t.period, uv, pv, sale_sum, sale_count, uv / sale_count AS uv_over_sale_count,
          pv / sale_count AS pv_over_sale_count, uv / sale_sum AS uv_over_sale_sum, pv / sale_sum AS pv_over_sale_sum
        FROM (SELECT store_id AS shop_id, week(enter_date) AS period, count(DISTINCT pid) AS uv, count(*) AS pv
              FROM m_visits GROUP BY ALL) t
          JOIN (SELECT shop_id, week(date_id) AS period, CAST(sum(act_amt) AS DOUBLE) AS sale_sum, count(*) AS sale_count
              FROM m_shop_orders GROUP BY ALL) s USING (shop_id, period)""",
    "m_measures": """
        SELECT shop_id, period, 'uv_over_sale_count' AS measure, uv_over_sale_count AS value FROM m_ratios
        UNION ALL SELECT shop_id, period, 'pv_over_sale_count', pv_over_sale_count FROM m_ratios
        UNION ALL SELECT shop_id, period, 'uv_over_sale_sum', uv_over_sale_sum FROM m_ratios
        UNION ALL SELECT shop_id, period, 'pv_over_sale_sum', pv_over_sale_sum FROM m_ratios""",
    "m_fences": """
        SELECT period, measure, count(*) AS n, min(value) AS lowest, quantile_cont(value, .25) AS q1,
          quantile_cont(value, .5) AS median, quantile_cont(value, .75) AS q3, max(value) AS highest,
          quantile_cont(value, .25) - 1.5 * (quantile_cont(value, .75) - quantile_cont(value, .25)) AS lower_fence,
          quantile_cont(value, .75) + 1.5 * (quantile_cont(value, .75) - quantile_cont(value, .25)) AS upper_fence
        FROM m_measures GROUP BY ALL""",
    "m_period": """
        WITH a AS (SELECT category_2_edit, CASE WHEN count(*) = count(actual_area) THEN sum(actual_area) END AS area
                   FROM m_leases WHERE begin_date <= DATE '1998-03-01' AND finish_date >= DATE '1998-03-31' GROUP BY ALL),
        s AS (SELECT category_2_edit, CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_joined WHERE month_id = '1998-03' GROUP BY ALL)
        SELECT category_2_edit, sale, area, sale / area AS saleperarea FROM s LEFT JOIN a USING (category_2_edit)""",
    "m_quarter": """
        SELECT contract_code, category_2_edit, {} FROM m_leases""".format(
        ", ".join(
            f"actual_area * GREATEST(0, (LEAST(DATE '1998-{b}', finish_date) - GREATEST(DATE '1998-{a}', begin_date))"
            f" / CAST(DATE '1998-{b}' - DATE '1998-{a}' AS DOUBLE)) AS {q}_area"
            for q, a, b in (("Q1", "01-01", "03-31"), ("Q2", "04-01", "06-30"),
                            ("Q3", "07-01", "09-30"), ("Q4", "10-01", "12-31"))
        )
    ),
    "m_year": """
        SELECT contract_code, category_2_edit, actual_area * GREATEST(0, (LEAST(DATE '1998-12-31', finish_date)
          - GREATEST(DATE '1998-01-01', begin_date)) / 364.0) AS area FROM m_leases""",
    "m_year_area": """
        SELECT category_2_edit, sum(area) AS area_sum FROM m_year GROUP BY ALL
        HAVING count(*) = count(area) AND sum(area) > 0""",
    "m_weekend": """
        WITH a AS (SELECT category_2_edit, CASE WHEN count(*) = count(actual_area) THEN sum(actual_area) END AS area
                   FROM m_leases WHERE begin_date <= DATE '1998-07-01' AND finish_date >= DATE '1998-07-31' GROUP BY ALL),
        s AS (SELECT category_2_edit, CASE WHEN isodow(date_id) >= 6 THEN 'weekend' ELSE 'weekday' END AS ifweekend,
                CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_joined WHERE month_id = '1998-07' GROUP BY ALL)
        SELECT category_2_edit, ifweekend, sale, area, sale / area AS saleperarea FROM s LEFT JOIN a USING (category_2_edit)""",
    "m_brands": """
        SELECT category_2_edit, series_name, brand_name, category_name_1,
          CAST(sum(act_amt) AS DOUBLE) / actual_area AS saleperarea, CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS n
        FROM m_joined GROUP BY category_2_edit, series_name, brand_name, category_name_1, contract_code, actual_area""",
}

for _name, _source in (("m_split_sum", "m_stall_sum"), ("m_split_stalls", "m_stalls")):
    SHARED[_name] = SHARED[_source].replace("m_stall_sum", "m_split_sum").replace("m_stall_month", "m_split_month")

SQL = {
    "valid_orders": """
        SELECT ordr_id, date_id, month_id, shop_id, contract_code, CAST(act_amt AS DOUBLE) AS act_amt FROM m_valid
        WHERE mall_name LIKE '%ASIA%' AND date_id BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "valid_orders_trade_rule": """
        SELECT month_id, type, CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS record_num FROM m_sales
        WHERE ((type = 'OMS' AND ordr_status = 'Y') OR (type <> 'OMS' AND trade_amt > 0))
          AND substr(month_id, 1, 4) IN ('1996', '1997', '1998') GROUP BY ALL""",
    "promo_calendar": "SELECT * FROM m_promo",
    "contract_duration": """
        SELECT contract_code, brand_name, series_name, booth_code, booth_grade, booth_name, category_name_1,
          category_name_2, category_name_3, floor_name, rentable_area, actual_area, zx_price,
          round(month_amount, 6) AS month_amount, CAST(finish_date - begin_date AS BIGINT) AS contract_duration,
          begin_date, finish_date FROM m_contracts WHERE mall_name LIKE '%ASIA%'""",
    "survey_rename": """
        SELECT round(mall_sale_estimated, 6) AS mall_sale_estimated, round(total_sale_estimated, 6) AS total_sale_estimated,
          partner_name, partner_code, contact_name, 'warehouse' AS origin FROM m_survey
        UNION ALL SELECT round(mall_sale_estimated, 6), round(total_sale_estimated, 6), partner_name, '00' || partner_code,
          contact_name, 'sheet' FROM m_survey""",
    "day_scan": """
        SELECT CAST(d AS DATE) AS date_id, visits FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) r(d)
        LEFT JOIN (SELECT enter_date, count(*) AS visits FROM m_track WHERE dt BETWEEN '20240105' AND '20240118' GROUP BY ALL)
          ON enter_date = CAST(d AS DATE)""",
    "side_tables": """
        SELECT 'B' || CAST(p_partkey // 2 AS VARCHAR) AS booth_code, CAST(p_partkey // 66 AS VARCHAR) AS shop_id,
          p_name AS shop_name, r_name AS mall_name FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE r_name LIKE '%ASIA%'""",
    "first_rows": """
        SELECT CAST(event_id AS VARCHAR) AS id, user_id // 5 AS store_id, ts AS enter_time FROM events
        ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 600""",
    "employee_phones": "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS mobile FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "write_read_back": """
        SELECT ordr_id, shop_id, CAST(act_amt AS DOUBLE) AS act_amt, month_id FROM m_sales WHERE month_id = '1998-03'""",
    "daily_loads": """
        SELECT id, store_id, profile_id, dt FROM m_track WHERE dt BETWEEN '20240104' AND '20240111' AND (
          dt = '20240105' OR (dt <= '20240110' AND CAST(id AS BIGINT) % 2 = 0) OR (dt >= '20240108' AND CAST(id AS BIGINT) % 2 = 1))""",
    "category_backfill": """
        WITH j AS (
          SELECT act_amt, actual_area, cont_cat1_name AS o1, cont_cat2_name AS o2, cont_cat3_name AS o3,
            (trim(cont_cat1_name) = '' OR cont_cat1_name IS NULL) AS ob,
            CASE WHEN lb THEN cont_cat1_name ELSE category_name_1 END AS category_name_1,
            CASE WHEN lb THEN cont_cat2_name ELSE category_name_2 END AS category_name_2,
            CASE WHEN lb THEN cont_cat3_name ELSE category_name_3 END AS category_name_3
          FROM (SELECT d.*, c.actual_area, c.category_name_1, c.category_name_2, c.category_name_3,
                  (trim(c.category_name_1) = '' OR c.category_name_1 IS NULL) AS lb
                FROM m_dirty d LEFT JOIN m_contracts c USING (contract_code)))
        SELECT category_name_1, category_name_2, category_name_3,
          CASE WHEN ob THEN category_name_1 ELSE o1 END AS cont_cat1_name,
          CASE WHEN ob THEN category_name_2 ELSE o2 END AS cont_cat2_name,
          CASE WHEN ob THEN category_name_3 ELSE o3 END AS cont_cat3_name,
          count(*) AS record_num, CAST(sum(act_amt) AS DOUBLE) AS sale, round(CASE WHEN count(*) = count(act_amt / actual_area) THEN sum(act_amt / actual_area) END, 3) AS saleperarea
        FROM j GROUP BY ALL""",
    "enriched_orders": """
        SELECT ordr_id, contract_code, booth_code, CASE WHEN lb THEN cont_cat2_name ELSE category_name_2 END AS category_name_2,
          CASE WHEN NOT (trim(cont_cat1_name) = '' OR cont_cat1_name IS NULL) THEN cont_cat2_name
               WHEN lb THEN cont_cat2_name ELSE category_name_2 END AS cont_cat2_name,
          round(CAST(act_amt AS DOUBLE) / actual_area, 6) AS avg_amt
        FROM (SELECT d.*, c.actual_area, c.booth_code, c.category_name_2,
                (trim(c.category_name_1) = '' OR c.category_name_1 IS NULL) AS lb
              FROM m_dirty d LEFT JOIN m_contracts c USING (contract_code))""",
    "contract_repair_rules": """
        SELECT CASE WHEN trim(contract_code) <> '' THEN contract_code WHEN contains(shop_name, '#00000000') THEN '0000000001'
          WHEN contains(shop_name, '#00000001') THEN '0000000002' WHEN contains(shop_name, '#0000000') THEN '0000000003'
          ELSE contract_code END AS contract_code, count(*) AS record_num FROM m_dirty WHERE contract_code IS NOT NULL GROUP BY 1""",
    "category_dict": "SELECT contract_code, category_name_2, category_2_edit FROM m_leases",
    "promo_flag": """
        SELECT date_id, count(*) AS record_num, EXISTS (SELECT 1 FROM m_promo WHERE s.date_id BETWEEN begin_date AND end_date) AS onsale
        FROM m_sales s GROUP BY date_id""",
    "booth_filter": """
        SELECT month_id, contract_code, booth_name, house_no, shop_id, sale FROM m_stall_month
        WHERE (regexp_matches(booth_name, 'N12|H7') OR regexp_matches(house_no, 'N12|H7'))
          AND month_id BETWEEN '1997-01' AND '1998-06' AND sale > 20000""",
    "trusted_sales": """
        SELECT ordr_id, partner_name, date_id, contract_code, CAST(act_amt AS DOUBLE) AS act_amt FROM m_sales
        WHERE date_id BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND partner_name IN (
          SELECT partner_name FROM m_labelled WHERE round(sum_act_amt / mall_sale_estimated, 9) < 1.5
            AND round(sum_act_amt / mall_sale_estimated, 9) > 0.75)""",
    "staff_purchases": """
        SELECT month_id, c_custkey IS NOT NULL AS staff_purchase, count(*) AS record_num, CAST(sum(act_amt) AS DOUBLE) AS sale
        FROM m_sales LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY') ON CAST(c_custkey AS VARCHAR) = mobile GROUP BY ALL""",
    "complete_rows": """
        SELECT ordr_id, booth_id, house_no, CAST(cont_unit_price AS DOUBLE) AS cont_unit_price, 'subset' AS kind FROM m_sales
        WHERE booth_id IS NOT NULL AND house_no IS NOT NULL
        UNION ALL SELECT ordr_id, booth_id, house_no, CAST(cont_unit_price AS DOUBLE), 'all' FROM m_sales
        WHERE booth_id IS NOT NULL AND house_no IS NOT NULL AND cont_unit_price IS NOT NULL""",
    "numeric_only": """
        SELECT contract_code, rentable_area, actual_area, zx_price, round(month_amount, 6) AS month_amount, begin_date, finish_date FROM m_contracts""",
    "label_remap": """
        SELECT contract_code, CAST(CASE booth_grade WHEN 'A' THEN 67 WHEN 'B' THEN 65 WHEN 'C' THEN 66 ELSE 68 END AS BIGINT) AS label FROM m_contracts""",
    "text_functions": """
        SELECT DISTINCT contract_code,
          CASE WHEN length(CAST(l_partkey + 9000 AS VARCHAR)) = 5 THEN 'p' ELSE 'p0' END || CAST(l_partkey + 9000 AS VARCHAR) AS padded,
          '00' || CAST(l_partkey + 9000 AS VARCHAR) AS dealer, 'm-' || house_no AS prefixed,
          CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 4 AS VARCHAR) || '楼' END AS floor_mark,
          concat_ws(chr(10), house_no, booth_id) AS label, regexp_matches(cont_cat2_name, '-1|-2') AS found,
          substr(month_id, 1, 4) AS year FROM m_sales""",
    "math_functions": """
        SELECT month_id, CAST(sum(CASE WHEN cont_unit_price IS NOT NULL THEN LEAST(act_amt, cont_unit_price) END) AS DOUBLE) AS least_sum,
          CAST(sum(CASE WHEN cont_unit_price IS NOT NULL THEN GREATEST(act_amt, cont_unit_price) END) AS DOUBLE) AS greatest_sum,
          CAST(sum(CAST(round(log10(CAST(act_amt AS DOUBLE)), 3) AS DECIMAL(18,3))) AS DOUBLE) AS log10_sum,
          CAST(sum(CAST(round(ln(CAST(act_amt AS DOUBLE)), 3) AS DECIMAL(18,3))) AS DOUBLE) AS ln_sum, CAST(0 AS BIGINT) AS undefined,
          count(DISTINCT booth_id) + max(CASE WHEN booth_id IS NULL THEN 1 ELSE 0 END) AS booths,
          CASE WHEN count(*) = count(cont_unit_price) THEN CAST(sum(cont_unit_price) AS DOUBLE) END AS strict,
          CAST(sum(CASE WHEN act_amt <= 0 OR act_amt > 50000 THEN NULL WHEN act_amt <= 1000 THEN 1 WHEN act_amt <= 20000 THEN 2 ELSE 3 END) AS BIGINT) AS buckets
        FROM m_sales GROUP BY month_id""",
    "sale_per_area_period": """
        SELECT category_2_edit, sale, area, round(saleperarea, 6) AS saleperarea,
          row_number() OVER (ORDER BY saleperarea DESC NULLS LAST, category_2_edit NULLS FIRST) AS id FROM m_period""",
    "stall_month": """
        SELECT * EXCLUDE (house_no, shop_name) REPLACE (round(saleperarea, 6) AS saleperarea) FROM m_stall_month""",
    "stall_metrics": """
        SELECT * REPLACE (round(saleperarea, 4) AS saleperarea, round(saleperareaperduration, 4) AS saleperareaperduration) FROM m_stalls""",
    "quarter_area": """
        SELECT contract_code, round(Q1_area, 6) AS Q1_area, round(Q2_area, 6) AS Q2_area, round(Q3_area, 6) AS Q3_area,
          round(Q4_area, 6) AS Q4_area FROM m_quarter""",
    "year_area": "SELECT contract_code, round(area, 6) AS area FROM m_year",
    "seasonal_sale_per_area": """
        WITH a AS (SELECT category_2_edit, sum(Q1_area) AS Q1, sum(Q2_area) AS Q2, sum(Q3_area) AS Q3, sum(Q4_area) AS Q4
                   FROM m_quarter GROUP BY ALL HAVING count(*) = count(Q1_area) AND sum(Q1_area + Q2_area + Q3_area + Q4_area) > 0),
        s AS (SELECT category_2_edit, quarter(date_id) AS q, CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_joined
              WHERE month_id LIKE '1998%' GROUP BY ALL),
        w AS (SELECT category_2_edit, max(CASE WHEN q = 1 THEN sale END) AS s1, max(CASE WHEN q = 2 THEN sale END) AS s2,
                max(CASE WHEN q = 3 THEN sale END) AS s3, max(CASE WHEN q = 4 THEN sale END) AS s4 FROM s GROUP BY ALL),
        j AS (SELECT w.*, Q1, Q2, Q3, Q4 FROM w LEFT JOIN a USING (category_2_edit))
        SELECT category_2_edit, 'sale_perarea_Q1' AS quarter, round(s1 / NULLIF(Q1, 0), 6) AS saleperarea FROM j
        UNION ALL SELECT category_2_edit, 'sale_perarea_Q2', round(s2 / NULLIF(Q2, 0), 6) FROM j
        UNION ALL SELECT category_2_edit, 'sale_perarea_Q3', round(s3 / NULLIF(Q3, 0), 6) FROM j
        UNION ALL SELECT category_2_edit, 'sale_perarea_Q4', round(s4 / NULLIF(Q4, 0), 6) FROM j""",
    "yearly_sale_per_area": """
        SELECT category_2_edit, shop_id, sale, round(area_sum, 6) AS area_sum, round(sale / area_sum, 6) AS sale_perarea_year
        FROM (SELECT category_2_edit, shop_id, CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_joined WHERE month_id LIKE '1998%' GROUP BY ALL)
          LEFT JOIN m_year_area USING (category_2_edit)""",
    "weekend_split": """
        SELECT category_2_edit, ifweekend, sale, area, round(saleperarea, 6) AS saleperarea,
          round(CASE WHEN ifweekend = 'weekend' THEN saleperarea ELSE -saleperarea END, 6) AS saleperarea_mirror FROM m_weekend""",
    "weekend_index": """
        SELECT category_2_edit, round(wd, 6) AS weekday, round(we, 6) AS weekend, round(we / wd, 6) AS weekend_index FROM (
          SELECT category_2_edit, max(CASE WHEN ifweekend = 'weekday' THEN saleperarea END) AS wd,
            max(CASE WHEN ifweekend = 'weekend' THEN saleperarea END) AS we FROM m_weekend GROUP BY ALL)""",
    "promo_index": """
        WITH s AS (SELECT category_2_edit, EXISTS (SELECT 1 FROM m_promo WHERE j.date_id BETWEEN m_promo.begin_date AND m_promo.end_date) AS onsale,
                     act_amt FROM m_joined j WHERE month_id LIKE '1998%'),
        r AS (SELECT category_2_edit, onsale, CAST(sum(act_amt) AS DOUBLE) / any_value(area_sum) AS v
              FROM s LEFT JOIN m_year_area USING (category_2_edit) GROUP BY ALL),
        w AS (SELECT category_2_edit, max(CASE WHEN NOT onsale THEN v END) AS f, max(CASE WHEN onsale THEN v END) AS t FROM r GROUP BY ALL)
        SELECT category_2_edit, round(f, 6) AS off_sale, round(t, 6) AS on_sale, round(t / f, 6) AS onsale_index FROM w""",
    "category_index": """
        SELECT category_2_edit, sale, area, round(saleperarea, 6) AS saleperarea,
          round((SELECT median(saleperarea) FROM m_period), 6) AS saleperarea_median,
          round(saleperarea / (SELECT median(saleperarea) FROM m_period), 6) AS cat2_index FROM m_period""",
    "brand_index": """
        WITH b AS (SELECT category_2_edit, series_name, CASE WHEN count(*) = count(saleperarea) THEN sum(saleperarea) END AS v,
                     sum(sale) AS sale, CAST(sum(n) AS BIGINT) AS record_num FROM m_brands GROUP BY ALL),
        m AS (SELECT category_2_edit, median(v) AS m FROM b GROUP BY ALL)
        SELECT b.category_2_edit, series_name, round(v, 3) AS saleperarea, round(sale, 3) AS sale, record_num,
          round(m, 3) AS saleperarea_median, round(v / m, 3) AS brand_index
        FROM b LEFT JOIN m ON b.category_2_edit IS NOT DISTINCT FROM m.category_2_edit""",
    "best_brands": """
        SELECT category_name_1, brand_name, round(CASE WHEN count(*) = count(saleperarea) THEN sum(saleperarea) END, 3) AS saleperarea,
          round(sum(sale), 3) AS sale, CAST(sum(n) AS BIGINT) AS record_num FROM m_brands
        WHERE category_name_1 IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY ALL""",
    "category_totals": """
        SELECT cont_cat1_name AS category, CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS record_num, 'cont_cat1_name' AS level FROM m_valid GROUP BY 1
        UNION ALL SELECT cont_cat2_name, CAST(sum(act_amt) AS DOUBLE), count(*), 'cont_cat2_name' FROM m_valid GROUP BY 1
        UNION ALL SELECT cont_cat3_name, CAST(sum(act_amt) AS DOUBLE), count(*), 'cont_cat3_name' FROM m_valid GROUP BY 1""",
    "floor_totals": """
        SELECT floor_name, CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS record_num FROM m_joined GROUP BY 1""",
    "category_month_wide": """
        SELECT month_id, {} FROM m_valid GROUP BY month_id""".format(
        ", ".join(
            f"CAST(sum(CASE WHEN cont_cat1_name = '{c}' THEN act_amt END) AS DOUBLE) AS \"{c}\""
            for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
        )
    ),
    "top_categories": """
        SELECT cont_cat2_name, CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "months_union": """
        SELECT cont_cat1_name, 'Q' || CAST(quarter(date_id) AS VARCHAR) AS quarter, CAST(sum(act_amt) AS DOUBLE) AS sale FROM m_sales GROUP BY ALL""",
    "month_index": """
        SELECT month_id, cont_cat1_name, CAST(sum(act_amt) AS DOUBLE) AS sale, dense_rank() OVER (ORDER BY month_id) AS month_no
        FROM m_sales GROUP BY month_id, cont_cat1_name""",
    "brand_peers": """
        SELECT * FROM (
          SELECT brand_name, begin_date, contract_code, booth_code, round(saleperareaperduration, 4) AS saleperareaperduration,
            count(*) OVER w - 1 AS peers,
            round((SELECT avg(o.saleperareaperduration) FROM m_stalls o WHERE o.brand_name = s.brand_name
              AND o.begin_date = s.begin_date AND o.contract_code <> s.contract_code), 4) AS peer_mean,
            round(min(saleperareaperduration) OVER w, 4) AS group_lowest, round(max(saleperareaperduration) OVER w, 4) AS group_highest
          FROM m_stalls s WINDOW w AS (PARTITION BY brand_name, begin_date)) WHERE peers > 0""",
    "brands_in_both": """
        SELECT brand_name || ' ' || series_name AS brand_name FROM m_contracts WHERE mall_name = 'ASIA'
        INTERSECT SELECT brand_name || ' ' || series_name FROM m_contracts WHERE mall_name = 'EUROPE'""",
    "grid_lookup": "SELECT * FROM m_grid",
    "floor_heat": """
        WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booth_code ORDER BY contract_code DESC) AS k FROM m_stalls) WHERE k = 1)
        SELECT floor, row, col, g.booth_code, COALESCE(saleperareaperdurationinterval, 0) AS value,
          COALESCE(concat_ws(chr(10), series_name, brand_name), '') AS label, COALESCE(booth_grade, '') AS grade
        FROM m_grid g LEFT JOIN s ON g.booth_code = s.booth_code""",
    "floor_heat_by_lease": """
        SELECT floor, row, col, l.contract_code, COALESCE(round(saleperarea, 4), 0) AS value, COALESCE(brand_name, '') AS label,
          COALESCE(booth_grade, '') AS grade FROM m_layout l LEFT JOIN m_stalls s ON l.contract_code = s.contract_code""",
    "booth_visitors": "SELECT * FROM m_booth_uv",
    "floor_footfall": """
        SELECT floor, row, col, g.booth_code, COALESCE(value, 0) AS value, COALESCE(label, '') AS label FROM m_grid g
        LEFT JOIN (SELECT booth_code, min(month_daily_uv) AS value, min(shop_name) AS label FROM m_booth_uv GROUP BY 1) f
          ON g.booth_code = f.booth_code""",
    "floor_footfall_by_lease": """
        SELECT floor, row, col, l.contract_code, COALESCE(value, 0) AS value,
          COALESCE(brand_name || chr(10) || series_name, '') AS label
        FROM m_layout l LEFT JOIN (SELECT contract_code, min(month_daily_uv) AS value FROM m_booth_uv GROUP BY 1) f
          ON l.contract_code = f.contract_code LEFT JOIN m_stalls s ON l.contract_code = s.contract_code""",
    "split_booths": """
        SELECT DISTINCT replace(booth_name, 'N', 'B') AS booth_code, booth_name FROM (
          SELECT unnest(string_split(booth_name, '/')) AS booth_name FROM m_contracts)""",
    "booth_many_to_many": """
        WITH m AS (SELECT * REPLACE (replace(booth_name, 'N', 'B') AS booth_code) FROM m_stall_month),
        d AS (SELECT DISTINCT replace(n, 'N', 'B') AS code, n AS booth_name FROM (SELECT unnest(string_split(booth_name, '/')) AS n FROM m)),
        x AS (SELECT booth_name, booth_grade, contract_code, begin_date, saleperarea, unnest(string_split(booth_code, '/')) AS part FROM m)
        SELECT code AS booth_code, booth_grade, contract_code, begin_date,
          round(CASE WHEN count(*) = count(saleperarea) THEN sum(saleperarea) END, 3) AS saleperarea
        FROM x LEFT JOIN d USING (booth_name) GROUP BY ALL""",
    "split_booth_metrics": """
        SELECT * REPLACE (round(saleperarea, 4) AS saleperarea, round(saleperareaperduration, 4) AS saleperareaperduration) FROM m_split_stalls""",
    "stall_month_shared": """
        SELECT month_id, shop_id, contract_code, booth_code, category_name_3, round(CAST(sum(act_amt) AS DOUBLE) / actual_area, 6) AS saleperarea,
          CAST(sum(act_amt) AS DOUBLE) AS sale, count(*) AS order_num
        FROM (SELECT s.*, c.booth_code, c.actual_area, c.floor_name, c.booth_name, c.booth_grade, c.brand_name, c.series_name, c.begin_date, c.finish_date,
                CASE WHEN trim(c.category_name_1) = '' OR c.category_name_1 IS NULL THEN s.cont_cat3_name ELSE c.category_name_3 END AS category_name_3
              FROM m_valid s LEFT JOIN (
                SELECT * FROM m_contracts UNION ALL
                SELECT * REPLACE ('X' || booth_code AS booth_code, actual_area * 2 AS actual_area) FROM m_contracts
                WHERE CAST(contract_code AS BIGINT) % 7 = 0) c USING (contract_code))
        GROUP BY month_id, category_name_3, floor_name, booth_code, booth_name, booth_grade, house_no, shop_name, shop_id, brand_name,
          series_name, contract_code, begin_date, finish_date, actual_area""",
    "dealer_totals": """
        WITH p AS (SELECT * FROM m_sales WHERE ((type = 'OMS' AND ordr_status = 'Y') OR (type <> 'OMS' AND trade_amt > 0))
                   AND date_id BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')
        SELECT partner_code, count(act_amt) AS freq, round(CAST(sum(act_amt) AS DOUBLE) / 10000, 6) AS sum_act_amt, max(partner_name) AS partner_name
        FROM p WHERE partner_code IN (SELECT partner_code FROM p WHERE mall_city_name = 'NATION_3') GROUP BY partner_code""",
    "dealer_places": """
        SELECT partner_code, partner_name, mall_name, shop_id, contract_code, min(date_id) AS min_date_id,
          CAST(sum(act_amt) AS DOUBLE) AS sum_act_amt, count(*) AS freq FROM m_sales GROUP BY ALL""",
    "dealer_labels": """
        SELECT * REPLACE (round(sum_act_amt, 6) AS sum_act_amt, round(mall_sale_estimated, 6) AS mall_sale_estimated,
          round(total_sale_estimated, 6) AS total_sale_estimated, round(relation_record_estimate_value, 6) AS relation_record_estimate_value)
        FROM m_labelled""",
    "trusted_dealers": """
        SELECT * REPLACE (round(sum_act_amt, 6) AS sum_act_amt, round(mall_sale_estimated, 6) AS mall_sale_estimated,
          round(total_sale_estimated, 6) AS total_sale_estimated, round(relation_record_estimate_value, 6) AS relation_record_estimate_value)
        FROM m_labelled WHERE round(sum_act_amt / mall_sale_estimated, 9) < 1.5 AND round(sum_act_amt / mall_sale_estimated, 9) > 0.75""",
    "survey_points": """
        SELECT partner_code, round(log10(sum_act_amt), 6) AS recorded_log, round(log10(mall_sale_estimated), 6) AS estimated_log,
          CASE WHEN sum_act_amt > mall_sale_estimated THEN 'sale_is_bigger' ELSE 'claim_is_bigger' END AS sale_vs_claim FROM m_labelled""",
    "dealer_or_match": """
        SELECT t.partner_code, s.partner_code AS survey_code, freq, round(sum_act_amt, 6) AS sum_act_amt, t.partner_name,
          round(mall_sale_estimated, 6) AS mall_sale_estimated, round(total_sale_estimated, 6) AS total_sale_estimated,
          s.partner_name AS survey_name, contact_name
        FROM m_totals t JOIN m_survey s ON t.partner_code = s.partner_code OR t.partner_name IN (s.partner_name, s.contact_name)""",
    "dealer_or_match_patchy": """
        SELECT t.partner_code, s.partner_code AS survey_code, freq, round(sum_act_amt, 6) AS sum_act_amt, t.partner_name,
          round(mall_sale_estimated, 6) AS mall_sale_estimated, round(total_sale_estimated, 6) AS total_sale_estimated,
          s.partner_name AS survey_name, contact_name
        FROM m_totals t JOIN (
          SELECT * REPLACE (CASE WHEN CAST(partner_code AS BIGINT) % 7 = 0 THEN NULL
              WHEN CAST(partner_code AS BIGINT) % 7 = 1 THEN lpad(CAST(CAST(partner_code AS BIGINT) - 1 AS VARCHAR), 10, '0')
              WHEN CAST(partner_code AS BIGINT) % 7 = 2 THEN ' ' ELSE partner_code END AS partner_code,
            CASE WHEN CAST(partner_code AS BIGINT) % 11 = 0 THEN ' ' ELSE partner_name END AS partner_name)
          FROM m_survey) s
        ON t.partner_code = s.partner_code OR t.partner_name = s.partner_name OR t.partner_name = s.contact_name""",
    "rmse": """
        SELECT round(sqrt(avg((l_quantity * 1000 - l_extendedprice) ** 2)), 6) AS by_quantity_rmse,
          round(sqrt(avg((l_quantity * 1000 * (1 - l_discount) - l_extendedprice) ** 2)), 6) AS by_discount_rmse FROM lineitem""",
    "next_period_rows": """
        SELECT f.shop_id, CAST(f.shop_id AS BIGINT) % 3 AS cluster, n.period, n.uv, n.pv, n.sale_sum, n.sale_count
        FROM m_ratios f JOIN m_ratios n ON f.shop_id = n.shop_id WHERE f.period = 1 AND n.period = 2""",
    "training_rows": """
        SELECT contract_code, CASE WHEN CAST('0x' || substr(md5('666|' || contract_code), 1, 8) AS BIGINT) % 100 < 90
            THEN 'train' ELSE 'test' END AS part
        FROM m_contracts WHERE category_name_1 IS NOT NULL AND rentable_area IS NOT NULL AND actual_area IS NOT NULL""",
    "split": """
        WITH s AS (SELECT CAST('0x' || substr(md5('666|' || ordr_id), 1, 8) AS BIGINT) % 100 < 90 AS first FROM m_sales)
        SELECT 'train' AS part, count(*) AS n FROM s WHERE first UNION ALL SELECT 'test', count(*) FROM s WHERE NOT first
        UNION ALL SELECT 'both', 0""",
    "classifier_folds": """
        WITH r AS (SELECT unnest([0, 1, 2]) AS repeat),
        t AS (SELECT partner_code FROM m_labelled WHERE relation_record_estimate_real IS NOT NULL
          AND partner_code IN (SELECT partner_code FROM m_sales GROUP BY 1 HAVING count(DISTINCT ordr_date) > 1)
          AND CAST('0x' || substr(md5('666|' || partner_code), 1, 8) AS BIGINT) % 100 < 90)
        SELECT partner_code, CAST(repeat AS BIGINT) AS repeat, CAST('0x' || substr(md5((666 + repeat) || '|' || partner_code), 1, 8) AS BIGINT) % 10 AS fold
        FROM t, r""",
    "self_training_pairs": """
        WITH RECURSIVE lines AS (SELECT *, row_number() OVER () AS id FROM lineitem),
        p AS (
          SELECT id, l_returnflag AS t, CASE WHEN l_linenumber = 1 THEN l_returnflag END AS label, unnest([0, 1, 2]) AS pair,
            unnest([l_quantity / 50, l_extendedprice / 100000, l_discount * 10])::DOUBLE AS u,
            unnest([l_extendedprice / 100000, l_discount * 10, l_tax * 10])::DOUBLE AS v FROM lines),
        m AS (
          SELECT 0 AS round, pair, label, avg(u) AS u, avg(v) AS v FROM p WHERE label IS NOT NULL GROUP BY pair, label
          UNION ALL
          SELECT round + 1, pair, label, avg(u), avg(v) FROM (
            SELECT m.round, p.pair, p.id, any_value(p.u) AS u, any_value(p.v) AS v,
              coalesce(any_value(p.label), arg_min(m.label, ((p.u - m.u) * (p.u - m.u) + (p.v - m.v) * (p.v - m.v), m.label))) AS label
            FROM p JOIN m ON p.pair = m.pair WHERE m.round < 60 GROUP BY m.round, p.pair, p.id) g
          GROUP BY round, pair, label),
        same AS (
          SELECT a.pair, a.round FROM m a JOIN m b ON a.pair = b.pair AND a.label = b.label AND b.round = a.round - 1
          GROUP BY ALL HAVING bool_and(abs(a.u - b.u) <= 1e-12 AND abs(a.v - b.v) <= 1e-12)),
        stop AS (SELECT pair, min(round) AS rounds FROM same GROUP BY pair),
        d AS (
          SELECT p.pair, p.id, p.t, m.label, m.round, s.rounds, (p.u - m.u) * (p.u - m.u) + (p.v - m.v) * (p.v - m.v) AS d
          FROM p JOIN stop s USING (pair) JOIN m ON m.pair = p.pair AND (m.round = 0 OR m.round = s.rounds)),
        e AS (
          SELECT pair, rounds, id, any_value(t) AS t, arg_min(label, (d, label)) FILTER (round = 0) AS before,
            arg_min(label, (d, label)) FILTER (round = rounds) AS after FROM d GROUP BY pair, rounds, id)
        SELECT ['quantity', 'price', 'discount'][pair + 1] AS feature_u, ['price', 'discount', 'tax'][pair + 1] AS feature_v,
          CAST(rounds AS BIGINT) AS rounds, round(avg(CASE WHEN before <> t THEN 1.0 ELSE 0.0 END), 6) AS error_before,
          round(avg(CASE WHEN after <> t THEN 1.0 ELSE 0.0 END), 6) AS error_after
        FROM e GROUP BY pair, rounds""",
    "nearest_mean_error": """
        WITH p AS (SELECT l_returnflag AS t, l_linenumber AS i, l_quantity / 50 AS q, l_extendedprice / 100000 AS x FROM lineitem),
        m AS (SELECT t AS label, avg(q) AS mq, avg(x) AS mx FROM p WHERE i = 1 GROUP BY 1),
        w AS (SELECT max(mq) FILTER (WHERE label = 'A') AS aq, max(mx) FILTER (WHERE label = 'A') AS ax,
                max(mq) FILTER (WHERE label = 'N') AS nq, max(mx) FILTER (WHERE label = 'N') AS nx,
                max(mq) FILTER (WHERE label = 'R') AS rq, max(mx) FILTER (WHERE label = 'R') AS rx FROM m),
        d AS (SELECT t, (q - aq) * (q - aq) + (x - ax) * (x - ax) AS a, (q - nq) * (q - nq) + (x - nx) * (x - nx) AS n,
                (q - rq) * (q - rq) + (x - rx) * (x - rx) AS r FROM p, w)
        SELECT round(avg(CASE WHEN CASE WHEN a <= n AND a <= r THEN 'A' WHEN n <= r THEN 'N' ELSE 'R' END <> t THEN 1.0 ELSE 0.0 END), 6)
          AS error_rate FROM d""",
    "duplicate_names": """
        SELECT * REPLACE (round(sum_act_amt, 6) AS sum_act_amt), count(*) OVER (PARTITION BY partner_name) > 1 AS often FROM m_totals""",
    "dealer_gaps": "SELECT partner_code, round(gap, 6) AS gap, count(*) AS n FROM m_gaps WHERE gap IS NOT NULL GROUP BY ALL",
    "dealer_gap_statistics": """
        SELECT * REPLACE (round(reg_time_perc, 6) AS reg_time_perc, round(min_time_space, 6) AS min_time_space,
          round(min_time_space_nonzero, 6) AS min_time_space_nonzero) FROM m_gap_stats""",
    "dealer_longest_run": "SELECT partner_code, CAST(max_cont_hit AS BIGINT) AS max_cont_hit, CAST(max_cont_hit_nozero AS BIGINT) AS max_cont_hit_nozero FROM m_runs",
    "customer_longest_run": """
        WITH g AS (SELECT cust_name, date_id, i, date_id - lag(date_id) OVER (PARTITION BY cust_name ORDER BY date_id, i) AS gap
                   FROM (SELECT cust_name, date_id, row_number() OVER () AS i FROM m_sales)),
        r AS (SELECT *, sum(CASE WHEN gap < 2 THEN 0 ELSE 1 END) OVER w AS ia, sum(CASE WHEN gap < 2 AND gap <> 0 THEN 0 ELSE 1 END) OVER w AS ib
              FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY cust_name ORDER BY date_id, i ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT cust_name, max(c) AS x FROM (SELECT cust_name, ia, count(*) FILTER (WHERE gap < 2) AS c FROM r GROUP BY ALL) GROUP BY 1),
        b AS (SELECT cust_name, max(c) AS x FROM (SELECT cust_name, ib, count(*) FILTER (WHERE gap < 2 AND gap <> 0) AS c FROM r GROUP BY ALL) GROUP BY 1)
        SELECT cust_name AS partner_code, a.x AS max_cont_hit, b.x AS max_cont_hit_nozero FROM a JOIN b USING (cust_name)""",
    "dealer_isolated": "SELECT partner_code, isolated, orders, round(isolated * 1.0 / orders, 6) AS isolated_perc FROM m_isolated",
    "dealer_peak_day": """
        SELECT partner_code, max(c) AS max_freq_in_day FROM (SELECT partner_code, date_id, count(*) AS c FROM m_sales GROUP BY ALL) GROUP BY 1""",
    "dealer_big_share": """
        SELECT partner_code, count(*) FILTER (WHERE act_amt > 20000) AS over_500_sum, count(*) FILTER (WHERE act_amt <= 20000) AS below_500_sum,
          round(count(*) FILTER (WHERE act_amt > 20000) / count(*), 6) AS big_sale_percentage FROM m_sales GROUP BY 1""",
    "dealer_booths": """
        SELECT partner_code, count(DISTINCT booth_id) + max(CASE WHEN booth_id IS NULL THEN 1 ELSE 0 END) AS num_booth FROM m_sales GROUP BY 1""",
    "dealer_entropy": """
        SELECT partner_code, count(*) AS category_num, round(sum(-p * ln(p)) / count(*), 6) AS cust_entropy FROM (
          SELECT partner_code, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY partner_code) AS p
          FROM m_sales GROUP BY partner_code, cust_name) GROUP BY partner_code""",
    "dealer_top_category": "SELECT * FROM {} JOIN {} USING (partner_code) JOIN {} USING (partner_code)".format(
        *[
            f"""(SELECT partner_code, cont_cat{i}_name, round(c / s, 6) AS cat{i}_perc_value FROM (
              SELECT partner_code, cont_cat{i}_name, count(*) AS c, sum(count(*)) OVER (PARTITION BY partner_code) AS s,
                row_number() OVER (PARTITION BY partner_code ORDER BY count(*) DESC, min(ordr_date), cont_cat{i}_name NULLS FIRST) AS k
              FROM m_dirty GROUP BY partner_code, cont_cat{i}_name) WHERE k = 1)"""
            for i in (1, 2, 3)
        ]
    ),
    "missing_share": """
        SELECT partner_code, round(avg(CASE WHEN house_no IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_house_no,
          round(avg(CASE WHEN cont_unit_price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_cont_unit_price FROM m_sales GROUP BY 1""",
    "status_share_wide": "SELECT partner_code, {} FROM m_sales GROUP BY 1".format(
        ", ".join(
            f"round(NULLIF(count(*) FILTER (WHERE ordr_status = '{s}'), 0) / count(*), 6) AS \"{s}\""
            for s in ("3", "15", "X", "Y", "Z")
        )
    ),
    "status_share_groups": """
        SELECT partner_code, {}, {} FROM m_sales GROUP BY 1 HAVING count(*) FILTER (WHERE ordr_status NOT IN ('Y', 'N')) > 0""".format(
        ", ".join(
            f"round(NULLIF(count(*) FILTER (WHERE ordr_status = '{s}'), 0) / count(*) FILTER (WHERE ordr_status NOT IN ('Y', 'N')), 6) AS \"{s}\""
            for s in ("3", "15", "X")
        ),
        ", ".join(
            f"round(NULLIF(count(*) FILTER (WHERE ordr_status = '{s}'), 0) / NULLIF(count(*) FILTER (WHERE ordr_status IN ('Y', 'N')), 0), 6) AS \"{s}\""
            for s in ("Y", "N")
        ),
    ),
    "dealer_features": """
        SELECT * REPLACE (round(reg_time_perc, 6) AS reg_time_perc, round(isolated_perc, 6) AS isolated_perc,
          round(min_time_space, 6) AS min_time_space, round(min_time_space_nonzero, 6) AS min_time_space_nonzero,
          CAST(max_cont_hit AS BIGINT) AS max_cont_hit, CAST(max_cont_hit_nozero AS BIGINT) AS max_cont_hit_nozero,
          round(big_sale_percentage, 6) AS big_sale_percentage, round(cust_entropy, 6) AS cust_entropy,
          round(cat3_perc_value, 6) AS cat3_perc_value, round(missing_house_no, 6) AS missing_house_no,
          round(missing_cont_unit_price, 6) AS missing_cont_unit_price, round("15", 6) AS "15", round("3", 6) AS "3",
          round("7", 6) AS "7", round("Y", 6) AS "Y") FROM m_features""",
    "model_table": """
        SELECT partner_code, max_freq_in_day, round(reg_time_perc, 6) AS reg_time_perc,
          round(min_time_space, 6) AS min_time_space, round(min_time_space_nonzero, 6) AS min_time_space_nonzero,
          CAST(max_cont_hit AS BIGINT) AS max_cont_hit, CAST(max_cont_hit_nozero AS BIGINT) AS max_cont_hit_nozero,
          round(isolated_perc, 6) AS isolated_perc, over_500_sum, below_500_sum, round(big_sale_percentage, 6) AS big_sale_percentage,
          num_booth, category_num, round(cust_entropy, 6) AS cust_entropy, round(cat3_perc_value, 6) AS cat3_perc_value,
          round(missing_house_no, 6) AS missing_house_no, round(missing_cont_unit_price, 6) AS missing_cont_unit_price,
          round(COALESCE("15", 0) + COALESCE("3", 0) + COALESCE("Y", 0), 6) AS agree_degree FROM m_features""",
    "visit_prep": """
        SELECT id, profile_id, store_id, enter_date, enter_time, round(stay_us / 6e7, 6) AS duration FROM m_track WHERE event_type = 0 AND stay_us >= 300000000""",
    "visits_of_one_shop": "SELECT id, profile_id, round(stay_us / 6e7, 6) AS duration FROM m_track WHERE event_type = 0 AND store_id = '2'",
    "visits_without_staff": "SELECT id, profile_id, store_id, round(duration, 6) AS duration FROM m_visits",
    "unmatched_orders": """
        SELECT ordr_id, 'shop and day' AS kind FROM m_shop_orders o WHERE NOT EXISTS (
          SELECT 1 FROM m_visits v WHERE v.store_id = o.shop_id AND v.enter_date = o.date_id)
        UNION ALL SELECT ordr_id, 'shop' FROM m_shop_orders o WHERE NOT EXISTS (SELECT 1 FROM m_visits v WHERE v.store_id = o.shop_id)""",
    "visit_attribution": """
        SELECT ordr_id, visit_id, shop_id, date_id, round(duration, 6) AS duration FROM m_pairs WHERE person_related = 1""",
    "visit_pairs_of_one_shop": """
        SELECT ordr_id, visit_id, shop_id, date_id FROM m_pairs WHERE person_related = 1 AND shop_id = '2'""",
    "orders_per_visit": """
        SELECT v.id, store_id AS shop_id, enter_date AS date_id, count(o.ordr_id) AS related FROM m_visits v LEFT JOIN m_shop_orders o
          ON o.shop_id = v.store_id AND o.date_id = v.enter_date AND o.ordr_date BETWEEN v.enter_time AND v.exit_time GROUP BY ALL""",
    "person_days": """
        SELECT store_id AS shop_id, enter_date AS date_id, profile_id, count(DISTINCT v.id) AS visits,
          (SELECT count(*) FROM m_pairs p WHERE p.person_related = 1 AND p.shop_id = v.store_id AND p.date_id = v.enter_date
            AND p.profile_id = v.profile_id) AS related_sum, CAST(sum(stay_us) AS BIGINT) AS stay_us
        FROM m_visits v GROUP BY ALL""",
    "shop_traffic": "SELECT * REPLACE (round(median_duration, 6) AS median_duration, round(avg_duration, 6) AS avg_duration) FROM m_traffic",
    "shop_orders": "SELECT * FROM m_order_num",
    "related_traffic": """
        SELECT * REPLACE (round(median_related_duration, 6) AS median_related_duration, round(avg_related_duration, 6) AS avg_related_duration)
        FROM m_related_traffic""",
    "shop_analysis": """
        SELECT * REPLACE (round(median_duration, 6) AS median_duration, round(avg_duration, 6) AS avg_duration,
          round(median_related_duration, 6) AS median_related_duration, round(avg_related_duration, 6) AS avg_related_duration)
        FROM m_order_num JOIN m_traffic USING (shop_id, period) JOIN m_related_traffic USING (shop_id, period)""",
    "order_visit_features": """
        WITH p AS (SELECT *, sum(person_related) OVER (PARTITION BY shop_id, date_id, profile_id) AS related_sum FROM m_pairs),
        n AS (SELECT shop_id, date_id, count(DISTINCT ordr_id) AS order_num_perday FROM m_pairs GROUP BY ALL)
        SELECT ordr_id, prod_name, cont_cat3_name, CAST(act_amt AS DOUBLE) AS act_amt, order_num_perday, count(*) AS visit_times,
          CAST(sum(person_related) AS BIGINT) AS related_visit_times, round(max(stay_us) / 6e7, 6) AS max_duration,
          round(sum(stay_us) / count(*) / 6e7, 6) AS mean_duration,
          round(sum(stay_us) FILTER (WHERE person_related = 1) / count(*) FILTER (WHERE person_related = 1) / 6e7, 6) AS related_mean_duration,
          round(max(stay_us) FILTER (WHERE person_related = 1) / 6e7, 6) AS related_max_duration,
          round(min(GREATEST(0, epoch_us(enter_time) - epoch_us(ordr_date), epoch_us(ordr_date) - epoch_us(exit_time))) FILTER (WHERE stay_us >= 300000000) / 6e7, 6) AS time_distance,
          round(COALESCE(sum(stay_us) FILTER (WHERE related_sum > 0), 0) / 6e7, 6) AS related_person_duration_sum,
          round(count(*) / order_num_perday, 6) AS visit_per_order
        FROM p JOIN n USING (shop_id, date_id) GROUP BY ordr_id, prod_name, cont_cat3_name, act_amt, order_num_perday""",
    "monthly_uv": "SELECT * FROM m_uv",
    "dedupe_shop_booth": "SELECT * FROM m_booths",
    "distinct_visit_times": "SELECT count(*) AS pairs FROM (SELECT DISTINCT enter_time, exit_time FROM m_track)",
    "shops_only_in_sales": """
        SELECT DISTINCT shop_id, CASE WHEN shop_id IN (SELECT store_id FROM m_visits WHERE stay_us >= 18000000000) THEN 'present' ELSE 'absent' END AS kind
        FROM m_shop_orders""",
    "id_name_audit": """
        SELECT min(store_id) AS store_id, store_name, 'names' AS kind FROM m_track WHERE store_id IN (
          SELECT store_id FROM m_track GROUP BY 1 HAVING count(DISTINCT store_name) > 1) GROUP BY store_name
        UNION ALL SELECT store_id, min(store_name), 'ids' FROM m_track WHERE store_name IN (
          SELECT store_name FROM m_track GROUP BY 1 HAVING count(DISTINCT store_id) > 1) GROUP BY store_id""",
    "shop_ratios": "SELECT shop_id, period, uv, pv, sale_sum, sale_count, {} FROM m_ratios".format(
        ", ".join(f"round({a}_over_{b}, 6) AS {a}_over_{b}" for b in ("sale_count", "sale_sum") for a in ("uv", "pv"))
    ),
    "shop_ratios_scaled": "SELECT shop_id, period, {} FROM m_ratios".format(
        ", ".join(
            f"round(({c} - (SELECT min({c}) FROM m_ratios)) / CAST((SELECT max({c}) - min({c}) FROM m_ratios) AS DOUBLE), 6) AS {c}"
            for c in ("uv", "pv", "sale_sum", "sale_count", "uv_over_sale_count", "pv_over_sale_count", "uv_over_sale_sum", "pv_over_sale_sum")
        )
    ),
    "shop_ratios_standardised": "SELECT shop_id, period, uv, pv, sale_sum, sale_count, {} FROM m_ratios".format(
        ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM m_ratios)) / (SELECT stddev_samp({c}) FROM m_ratios), 6) AS {c}"
            for c in ("uv_over_sale_count", "pv_over_sale_count", "uv_over_sale_sum", "pv_over_sale_sum")
        )
    ),
    "outlier_fences": "SELECT period, measure, n, {} FROM m_fences".format(
        ", ".join(f"round({c}, 6) AS {c}" for c in ("lowest", "q1", "median", "q3", "highest", "lower_fence", "upper_fence"))
    ),
    "shop_outliers": """
        SELECT shop_id, period, measure, round(value, 6) AS value, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence
        FROM m_measures JOIN m_fences USING (period, measure) WHERE value < lower_fence OR value > upper_fence""",
    "nearest_mean": """
        WITH p AS (SELECT l_returnflag AS true_value, l_quantity / 50 AS q, l_extendedprice / 100000 AS x FROM lineitem),
        m AS (SELECT true_value AS label, avg(q) AS mq, avg(x) AS mx FROM p GROUP BY 1),
        w AS (SELECT max(mq) FILTER (WHERE label = 'A') AS aq, max(mx) FILTER (WHERE label = 'A') AS ax,
                max(mq) FILTER (WHERE label = 'N') AS nq, max(mx) FILTER (WHERE label = 'N') AS nx,
                max(mq) FILTER (WHERE label = 'R') AS rq, max(mx) FILTER (WHERE label = 'R') AS rx FROM m),
        d AS (SELECT true_value, (q - aq) * (q - aq) + (x - ax) * (x - ax) AS a, (q - nq) * (q - nq) + (x - nx) * (x - nx) AS n,
                (q - rq) * (q - rq) + (x - rx) * (x - rx) AS r FROM p, w)
        SELECT CASE WHEN a <= n AND a <= r THEN 'A' WHEN n <= r THEN 'N' ELSE 'R' END AS pred_value, true_value, count(*) AS n FROM d GROUP BY ALL""",
    "confusion": """
        SELECT l_linestatus AS pred_value, CASE WHEN l_returnflag = 'A' THEN 'F' ELSE 'O' END AS true_value, count(*) AS n FROM lineitem GROUP BY ALL""",
    "agreement": """
        WITH c AS (SELECT l_linestatus AS p, CASE WHEN l_returnflag = 'A' THEN 'F' ELSE 'O' END AS t, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
        r AS (SELECT p AS l, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT t AS l, sum(n) AS n FROM c GROUP BY 1),
        v AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n) FROM c WHERE p = t) AS h, (SELECT sum(n * (n - 1) / 2) FROM c) AS cc,
                (SELECT sum(n * (n - 1) / 2) FROM r) AS rr, (SELECT sum(n * (n - 1) / 2) FROM k) AS kk,
                (SELECT sum(r.n * k.n) FROM r JOIN k USING (l)) AS ch)
        SELECT round(h / n, 6) AS accuracy, round((h / n - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa,
          round((n * (n - 1) / 2 + 2 * cc - rr - kk) / (n * (n - 1) / 2), 6) AS rand,
          round((cc - rr * kk / (n * (n - 1) / 2)) / ((rr + kk) / 2 - rr * kk / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM v""",
}


def _needed(text: str) -> list[str]:
    found: dict[str, None] = {}

    def visit(part: str) -> None:
        for name in re.findall(r"\bm_[a-z0-9_]+\b", part):
            if name in SHARED and name not in found:
                visit(SHARED[name])
                found[name] = None

    visit(text)
    return list(found)


def full_sql(name: str) -> str:
    """The query with the shared tables it needs in front."""
    body = SQL[name].strip()
    shared = [f"{n} AS ({SHARED[n].strip()})" for n in _needed(body)]
    if not shared:
        return body
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(shared) + ",\n" + body[5:]
    return "WITH " + ",\n".join(shared) + "\n" + body
