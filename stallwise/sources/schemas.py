"""Column types of the delivered domain tables; nothing is inferred on read."""

ORDERS = """
    ordr_id string, date_id date, ordr_date timestamp, month_id string, mall_name string,
    mall_city_name string, prod_name string, shop_id string, shop_name string, booth_id string,
    booth_desc string, house_no string, partner_code string, partner_name string,
    cust_name string, contract_code string, act_amt decimal(18,2), trade_amt decimal(18,2),
    cont_unit_price decimal(18,2), prod_avg_discnt_rate double, coupon_amt decimal(18,2),
    ordr_status string, ordr_type string, type string, sale_type string, is_promotion string,
    is_coupon string, coupon_id string, cnt_cat1_num int, cnt_cat2_num int, cnt_cat3_num int,
    cont_cat1_name string, cont_cat2_name string, cont_cat3_name string,
    cont_cat1_code string, cont_cat2_code string, cont_cat3_code string,
    cont_main_brand_name string, open_id string, mobile string, name string, crdt string
"""

CONTRACTS = """
    contract_code string, mall_name string, brand_name string, series_name string,
    booth_code string, booth_grade string, booth_name string, category_name_1 string,
    category_name_2 string, category_name_3 string, floor_name string, rentable_area double,
    actual_area double, zx_price double, month_amount double, begin_date date, finish_date date
"""

PROMOTIONS = "prom_begin_time string, date string"

VISITS = """
    id string, profile_id string, pid string, mall_id string, store_id string,
    store_name string, event_type int, enter_time timestamp, exit_time timestamp,
    create_time timestamp, update_time timestamp, dt string
"""

STAFF = "rs_profile_id string, is_valid int, is_staff int"

DEALER_SURVEY = """
    business_num string, business_name string, link_name string,
    sell_amount_mall double, sell_amount_total double
"""

SHOP_BOOTHS = "booth_code string, shop_id string, shop_name string, mall_name string"

EMPLOYEES = "mobile string, isemp string"

LAYOUT = "floor string, row int, col int, contract_code string"
