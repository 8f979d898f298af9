"""SQL text of the graph views over the driver tables, for checking results in another engine."""

from __future__ import annotations

import re

VIEWS = {
    "nn": "select count(*) n from customer",
    "tx0": "select o_orderkey k, o_custkey a, (o_orderkey * 31 + 7) % n b, o_totalprice amount, "
           "o_orderdate ts, o_orderpriority pr from orders cross join nn",
    # instant-payment fraud graph
    "v_person": "select concat('P', c_custkey) id, c_name name, (c_custkey % 11 = 0) fraud_flag from customer",
    "v_account": "select concat('A', c_custkey) id, c_acctbal balance, c_mktsegment bank, "
                 "(c_acctbal < 0) fraud_block from customer",
    "v_card": "select concat('C', c_custkey) id, (c_custkey % 8 = 0) fraud_block from customer where c_custkey % 3 = 0",
    "v_vpa": "select concat('V', c_custkey) id from customer union all "
             "select concat('W', c_custkey) from customer where c_custkey % 3 = 0",
    "v_instrument": "select id, fraud_block from v_account union all select id, fraud_block from v_card",
    "e_has_account": "select concat('has_account#', src, '#', dst) eid, src, dst from ("
                     "select concat('P', c_custkey) src, concat('A', c_custkey) dst from customer union all "
                     "select concat('P', c_custkey - 1), concat('A', c_custkey) from customer where c_custkey % 5 = 1)",
    "e_has_card": "select concat('has_card#P', c_custkey, '#C', c_custkey) eid, concat('P', c_custkey) src, "
                  "concat('C', c_custkey) dst from customer where c_custkey % 3 = 0",
    "e_has": "select eid, src, dst from e_has_account union all select eid, src, dst from e_has_card",
    "e_owns": "select concat('owns#', src, '#', dst) eid, src, dst from ("
              "select concat('A', c_custkey) src, concat('V', c_custkey) dst from customer union all "
              "select concat('C', c_custkey), concat('W', c_custkey) from customer where c_custkey % 3 = 0)",
    "e_tx": "select concat('T', k) eid, "
            "case when a % 3 = 0 and k % 2 = 1 then concat('W', a) else concat('V', a) end src, "
            "case when b % 3 = 0 and k % 4 = 0 then concat('W', b) else concat('V', b) end dst, "
            "amount, cast(round(amount * 100) as bigint) cents, ts, concat('CITY_', k % 40) ip_city, "
            "(pr = '1-URGENT' and k % 7 = 0) fraud_flag from tx0",
    "e_dev": "select distinct concat('P', user_id) src, concat('D', regexp_extract(props, '([0-9]+)', 1)) dst "
             "from events",
    "pv": "select h.src person, o.dst vpa from e_has h join e_owns o on h.dst = o.src",
    "known": "select distinct pv.person, t.dst receiver from pv join e_tx t on t.src = pv.vpa",
    "req": "select concat('R', o_orderkey) payment, concat('P', o_custkey) person, concat('V', o_custkey) vpa, "
           "concat('V', case when o_orderkey % 3 = 0 then (o_orderkey * 31 + 7) % n "
           "else (o_orderkey * 17 + 3) % n end) target, cast(round(o_totalprice * 100) as bigint) cents, "
           "o_orderdate ts from orders cross join nn",
    # user / account / transfer graph
    "p_user": "select concat('U', c_custkey) id, concat('U', c_custkey) userid, c_name name, "
              "18 + c_custkey % 60 age from customer",
    "p_account": "select concat('A', c_custkey) id, concat('A', c_custkey) accountid, c_acctbal balance from customer",
    "p_owns": "select concat('owns#', c_custkey) eid, concat('U', c_custkey) src, concat('A', c_custkey) dst "
              "from customer",
    "p_tx": "select concat('T', k) eid, concat('A', a) src, concat('A', b) dst, amount, "
            "cast(round(amount * 100) as bigint) cents, case when k % 2 = 0 then 'debit' else 'credit' end type, "
            "ts from tx0",
    "p_edge": "select eid, 'owns' label, src, dst from p_owns union all "
              "select eid, 'Transaction', src, dst from p_tx",
    "p_both": "select eid, src k, dst f from p_edge union all select eid, dst, src from p_edge",
    "p_totals": "select a.id, a.accountid, coalesce(sum(t.cents), 0)::bigint total_cents "
                "from p_account a left join p_tx t on t.src = a.id group by 1, 2",
    # orders graph
    "f_customer": "select concat('customer_', c_custkey) id, c_name name from customer",
    "f_restaurant": "select concat('restaurant_', s_suppkey) id, s_name name from supplier",
    "f_item": "select concat('item_', p_partkey) id, p_name name, p_retailprice price from part",
    "f_driver": "select concat('driver_', o_orderkey % 50) id from orders group by 1",
    "f_order": "select concat('order_', o_orderkey) id, o_orderdate order_date, o_orderstatus status from orders",
    "f_placed": "select concat('PLACED#', o_orderkey) eid, concat('customer_', o_custkey) src, "
                "concat('order_', o_orderkey) dst, o_orderdate order_date from orders",
    "f_contains": "select concat('CONTAINS#', l_orderkey, '#', l_linenumber, '#', l_partkey, '#', l_suppkey) eid, "
                  "concat('order_', l_orderkey) src, concat('item_', l_partkey) dst, l_quantity qty from lineitem",
    "f_ordered_from": "select concat('ORDERED_FROM#', l_orderkey) eid, concat('order_', l_orderkey) src, "
                      "concat('restaurant_', min(l_suppkey)) dst from lineitem group by l_orderkey",
    "f_delivered_by": "select concat('DELIVERED_BY#', o_orderkey) eid, concat('order_', o_orderkey) src, "
                      "concat('driver_', o_orderkey % 50) dst from orders",
    "f_rated": "select concat('R', o_orderkey) eid, concat('customer_', o_custkey) src, f.dst dst, "
               "1 + o_orderkey % 5 rating, o_orderpriority comment from orders join f_ordered_from f "
               "on f.src = concat('order_', o_orderkey) where o_orderkey % 10 < 3",
    "f_edge": "select eid, src, dst from f_placed union all select eid, src, dst from f_contains union all "
              "select eid, src, dst from f_ordered_from union all select eid, src, dst from f_delivered_by "
              "union all select eid, src, dst from f_rated",
    "f_capped": "select k, eid, f from (select k, eid, f, row_number() over (partition by k order by eid, side) rn "
                "from (select src k, eid, dst f, 0 side from f_edge union all select dst, eid, src, 1 from f_edge)) "
                "where rn <= 5",
    "f_walk": "select seed, path from (select seed, path, row_number() over (partition by seed order by path) rn "
              "from (select c.id seed, [c.id, x.eid, x.f, y.eid, y.f] path from f_customer c "
              "join f_capped x on x.k = c.id join f_capped y on y.k = x.f "
              "where y.f <> c.id and y.f <> x.f and y.eid <> x.eid and x.f <> c.id)) where rn <= 150",
    # latency buckets from events
    "obs": "select event_type ns, concat('s', user_id % 7) service, value from events",
    "lim": "select unnest([1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 'Infinity'::double]) le",
    "buckets": "select s.ns, s.service, l.le::double le, "
               "(select count(*) from obs o where o.ns = s.ns and o.service = s.service and o.value <= l.le) cnt "
               "from (select distinct ns, service from obs) s cross join lim l",
}


def with_views(body: str) -> str:
    """``body`` preceded by a WITH clause of exactly the views it uses."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in need) + "\n" + body
