"""Named queries over the driver tables, each with its SQL twin where one exists.

A query is ``(spark, sf_dir) -> DataFrame``; it always runs over the whole tables.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions import scalars as C
from hopframe.functions.display import link_label, node_label
from hopframe.functions.rng import uniform
from hopframe.generators import degrees as gdeg
from hopframe.generators import ego, food, scale_free
from hopframe.generators import payments as gen_payments
from hopframe.generators.values import check_values, random_value
from hopframe.model import PropertyGraph
from hopframe.operators import messages, skew, update
from hopframe.operators.frontier import gte, neq
from hopframe.plans import degree, export, fraud, orders, payments, telemetry
from hopframe.session import fresh_path, materialize
from hopframe.sources import checks, csv_graph, parquet_graph
from hopframe.sources.driver_graph import (food_graph, fraud_graph, payment_requests, payments_graph, table,
                                           transfers)
from hopframe.sql_views import with_views
from hopframe.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def on(graph: Callable[[SparkSession, str], PropertyGraph], name: str, fn: Callable[[PropertyGraph], DataFrame],
       sql: str | None = None) -> None:
    """Register a query that only needs one of the graphs."""
    add(name, sql)(lambda spark, sf: fn(graph(spark, sf)))


def _text_path(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.array_join("path", ">").alias("path"))


def _big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# ---- sources and sinks -------------------------------------------------------

def _typed_products(spark, sf) -> PropertyGraph:
    """Parts as vertices with one property of every stored type."""
    p = table(spark, sf, "part")
    v = p.select(F.concat(F.lit("part"), "p_partkey").alias("id"), F.col("p_size").alias("size"),
                 F.col("p_partkey").alias("num"), F.col("p_retailprice").alias("price"),
                 (F.col("p_size") > 25).alias("big"), F.col("p_name").alias("name"),
                 F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("since"),
                 F.array("p_brand", "p_type").alias("tags"))
    return PropertyGraph({"Product": v}, ())


@add("s1_vertex_csv", """select concat('part', p_partkey) id, p_size::bigint size, p_partkey num, p_retailprice price,
 p_size > 25 big, p_name as name, strftime(date '2020-01-01' + p_size::int, '%Y-%m-%d') since,
 concat(p_brand, '|', p_type) tags from part""")
def _s1(spark, sf):
    root = fresh_path(spark, "csv")
    csv_graph.write_csv(_typed_products(spark, sf), root)
    rows = csv_graph.read_vertices(spark, f"{root}/vertices")[0].rows
    return rows.select(F.col("~id").alias("id"), F.col("size").cast("bigint").alias("size"), "num", "price", "big",
                       "name", F.col("since").cast("string").alias("since"),
                       F.array_join("tags", "|").alias("tags"))


@add("s2_edge_csv", "select src, dst, cents, type from p_tx")
def _s2(spark, sf):
    """Edge files whose system columns come in another order are bound by name."""
    root = fresh_path(spark, "csv")
    e = payments_graph(spark, sf).edge_view(["Transaction"], ["cents", "type"])
    e.select(F.col("label").alias("~label"), F.col("dst").alias("~to"), F.col("cents").alias("cents:long"),
             F.col("src").alias("~from"), F.col("type").alias("type:string")
             ).write.option("header", True).csv(f"{root}/edges/moves")
    rows = csv_graph.read_edges(spark, f"{root}/edges")[0].rows
    return rows.select(F.col("~from").alias("src"), F.col("~to").alias("dst"), "cents", "type")


@add("s14_csv_texts", """select doc_id::varchar id, case when doc_id % 5 = 0 then concat('  ', text, ' "q", ')
 when doc_id % 5 = 1 then '' when doc_id % 5 = 2 then null else text end as text from documents""")
def _s14t(spark, sf):
    """Texts with line breaks, quotes, outer spaces, empty and NULL come back from CSV as they were."""
    n = F.col("doc_id") % 5
    text = F.when(n == 0, F.concat(F.lit("  "), "text", F.lit(' "q", '))).when(n == 1, "").when(n == 2, None).otherwise(F.col("text"))
    v = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    root = fresh_path(spark, "csv")
    csv_graph.write_csv(PropertyGraph({"Note": v}, ()), root)
    part = csv_graph.read_vertices(spark, f"{root}/vertices")[0]
    return part.rows.select(F.col("~id").alias("id"), "text")


@add("s14_csv_escaped", """select doc_id::varchar id, case when doc_id % 5 = 0 then concat(text, chr(13), chr(10), '"\\n\\s ')
 when doc_id % 5 = 1 then '' when doc_id % 5 = 2 then null when doc_id % 5 = 3 then chr(1) else text end as text
 from documents""")
def _s14e(spark, sf):
    """Files that Spark splits: line breaks and backslashes are written as codes."""
    n = F.col("doc_id") % 5
    text = F.when(n == 0, F.concat("text", F.lit('\r\n"\\n\\s '))).when(n == 1, "").when(n == 2, None) \
        .when(n == 3, "\u0001").otherwise(F.col("text"))
    v = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    root = fresh_path(spark, "csv")
    csv_graph.write_csv(PropertyGraph({"Note": v}, ()), root, escaped=True)
    part = csv_graph.read_vertices(spark, f"{root}/vertices", multi_line=False)[0]
    return part.rows.select(F.col("~id").alias("id"), "text")


def _round_trip(spark, sf):
    root = fresh_path(spark, "csv")
    csv_graph.write_csv(payments_graph(spark, sf), root)
    return csv_graph.load(spark, f"{root}/vertices", f"{root}/edges", "merge",
                          endpoints={"owns": ("User", "Account"), "Transaction": ("Account", "Account")})


@add("s3_tree_load", """select 'User' label, id, name as text from p_user union all select 'Account', id, accountid
 from p_account""")
def _s3(spark, sf):
    g, _ = _round_trip(spark, sf)
    v = g.vertex_view()
    return v.select("label", "id", F.coalesce("name", "accountId").alias("text"))


@add("s4_typed_header", """select case when o_orderkey % 3 = 0 then -1 else o_orderkey end n,
 o_orderkey % 3 = 0 rejected from orders""")
def _s4(spark, sf):
    """Typed parse of text cells; what does not convert is flagged, not dropped."""
    raw = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey"))
        .otherwise(F.col("o_orderkey").cast("string")).alias("cell"))
    col = csv_graph.parse_header("n:long")
    value = csv_graph.typed(F.col("cell"), col.dtype)
    return raw.select(F.coalesce(value, F.lit(-1)).alias("n"), value.isNull().alias("rejected"))


@add("s5_header_repair", "select src, dst, 'owns' as label from p_owns")
def _s5(spark, sf):
    """``~label:String`` is read as ``~label``; a missing label column takes the folder name."""
    root = fresh_path(spark, "csv")
    e = payments_graph(spark, sf).edge_view(["owns"], ())
    odd = F.substring("src", 2, 20).cast("bigint") % 2 == 1
    (e.filter(odd).select(F.col("src").alias("~from"), F.col("dst").alias("~to"), F.col("label").alias("~label:String"))
     .write.option("header", True).csv(f"{root}/edges/part_a"))
    (e.filter(~odd).select(F.col("src").alias("~from"), F.col("dst").alias("~to"))
     .write.option("header", True).csv(f"{root}/edges/more/owns"))
    parts = csv_graph.read_edges(spark, f"{root}/edges")
    return parts[0].rows.unionByName(parts[1].rows).select(
        F.col("~from").alias("src"), F.col("~to").alias("dst"), F.col("~label").alias("label"))


@add("s6_load_report", """select 'vertices' stage, 'User' label, count(*) rows_in, count(*) rows_ok, 0::bigint rows_rejected
 from p_user union all select 'vertices', 'Account', count(*), count(*), 0 from p_account
 union all select 'edges', 'owns', count(*), count(*), 0 from p_owns
 union all select 'edges', 'Transaction', count(*), count(*), 0 from p_tx""")
def _s6(spark, sf):
    return _round_trip(spark, sf)[1]


@add("s6_load_validation", """with v as (select c_custkey k, c_custkey % 10 r from customer),
 e as (select o_custkey % 10 r from orders)
 select 'vertices' stage, 'Customer' label, count(*) rows_in, count(*) filter (r > 1) rows_ok,
 count(*) filter (r <= 1) rows_rejected from v union all
 select 'edges', 'knows', count(*), count(*) filter (r <> 5), count(*) filter (r = 5) from e union all
 select 'vertex validation', 'Customer', count(*) filter (r > 1), count(*) filter (r > 1 and r <> 3),
 count(*) filter (r = 3) from v union all
 select 'edge validation', 'knows', count(*) filter (r <> 5), count(*) filter (r not in (0, 1, 3, 5)),
 count(*) filter (r in (0, 1, 3)) from e""")
def _s6v(spark, sf):
    """Files with blank ids, cells of the wrong type, repeated ids and edges without a vertex."""
    root = fresh_path(spark, "csv")
    k, r = F.col("c_custkey"), F.col("c_custkey") % 10
    table(spark, sf, "customer").select(
        F.when(r != 0, F.concat(F.lit("c"), F.when(r == 3, k - 1).otherwise(k))).alias("~id"),
        F.when(r == 1, F.lit("one")).otherwise(k.cast("string")).alias("n:int"),
    ).write.option("header", True).csv(f"{root}/vertices/Customer")
    end, r = F.concat(F.lit("c"), "o_custkey"), F.col("o_custkey") % 10
    table(spark, sf, "orders").select(
        F.when(r != 5, end).alias("~from"), end.alias("~to")).write.option("header", True).csv(f"{root}/edges/knows")
    return csv_graph.load(spark, f"{root}/vertices", f"{root}/edges", "first", validated=True)[1]


def _repeated(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("order_"), "l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("open"))


@add("s7_duplicate_ids", """select concat('order_', l_orderkey) id, count(*) copies from lineitem
 group by 1 having count(*) > 1""")
def _s7a(spark, sf):
    return checks.duplicate_ids(_repeated(spark, sf))


@add("s7_resolve_merge", """select concat('order_', l_orderkey) id, min(l_returnflag) flag,
 min(case when l_linestatus = 'O' then l_linestatus end) "open" from lineitem group by 1""")
def _s7b(spark, sf):
    return checks.resolve_duplicates(_repeated(spark, sf), "merge")


@add("s7_resolve_first", """select id, flag, "open" from (select *, row_number() over (partition by id
 order by flag nulls first, "open" nulls first) rn from (select concat('order_', l_orderkey) id, l_returnflag flag,
 case when l_linestatus = 'O' then l_linestatus end "open" from lineitem)) where rn = 1""")
def _s7c(spark, sf):
    return checks.resolve_duplicates(_repeated(spark, sf), "first")


@add("s7_dangling_edges", """select concat('X', o_orderkey) eid, concat('U', o_custkey) src,
 concat('A', o_custkey * 2) dst from orders where o_custkey * 2 not in (select c_custkey from customer)
 or o_custkey not in (select c_custkey from customer)""")
def _s7d(spark, sf):
    g = payments_graph(spark, sf)
    e = table(spark, sf, "orders").select(
        F.concat(F.lit("X"), "o_orderkey").alias("eid"), F.concat(F.lit("U"), "o_custkey").alias("src"),
        F.concat(F.lit("A"), F.col("o_custkey") * 2).alias("dst"))
    return checks.dangling_edges(g, e)


on(payments_graph, "s7_validate", checks.validate, """select 'vertex validation' stage, 'User' label, 0::bigint problems
 union all select 'vertex validation', 'Account', 0 union all select 'edge validation', 'owns',
 (select count(*) from p_owns where src not in (select id from p_user) or dst not in (select id from p_account))
 union all select 'edge validation', 'Transaction', (select count(*) from p_tx
 where src not in (select id from p_account) or dst not in (select id from p_account))""")
on(payments_graph, "s8_supernodes", lambda g: skew.supernodes(g.edge_view(["Transaction"], ()), 15),
   "select src id, count(*) as degree from p_tx group by 1 having count(*) >= 15")


@add("s9_edge_ids", """select concat('buys#', sha256(concat('{"src":"', src, '","dst":"', dst, '"}')), '#', copy) eid,
 src, dst from (select concat('P', o_custkey) src, o_orderpriority dst, row_number() over
 (partition by o_custkey, o_orderpriority) copy from orders)""")
def _s9(spark, sf):
    e = table(spark, sf, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("src"),
                                          F.col("o_orderpriority").alias("dst"))
    return csv_graph.with_edge_ids(e, "buys")


def _adjacency_hop(spark, sf, hop):
    """Neighbours with the number of edges, over the stored adjacency."""
    root = fresh_path(spark, "adjacency")
    name = "adj_" + root.rsplit("-", 1)[1]
    stored = parquet_graph.save_adjacency(payments_graph(spark, sf), name, root, 8)
    return hop(stored.V("Account")).bulk().df.select("seed", F.col("cur").alias("id"), "n")


@add("s9_adjacency_out", "select src seed, dst id, count(*) n from p_tx group by 1, 2")
def _s9_out(spark, sf):
    return _adjacency_hop(spark, sf, lambda f: f.out("Transaction"))


@add("s9_adjacency_in", """select dst seed, src id, count(*) n from (select src, dst from p_tx union all
 select src, dst from p_owns) group by 1, 2""")
def _s9_in(spark, sf):
    return _adjacency_hop(spark, sf, lambda f: f.in_())


@add("s10_write_counts", """select 'vertex' kind, 'User' label, (select count(*) from p_user) as rows union all
 select 'vertex', 'Account', (select count(*) from p_account) union all
 select 'edge', 'owns', (select count(*) from p_owns) union all
 select 'edge', 'Transaction', (select count(*) from p_tx)""")
def _s10(spark, sf):
    counts = parquet_graph.write_graph(payments_graph(spark, sf), fresh_path(spark, "graph"))
    return spark.createDataFrame([(k, x, n) for (k, x), n in counts.items()], "kind string, label string, rows bigint")


on(payments_graph, "s11_v", lambda g: g.V().ids().select("id", "label"),
   "select id, 'User' label from p_user union all select id, 'Account' from p_account")
on(payments_graph, "s11_v_ids", lambda g: g.V(ids=g.edge_view(["Transaction"], ()).select(F.col("dst").alias("id")))
   .ids().select("id", "label"), "select id, 'Account' label from p_account where id in (select dst from p_tx)")
on(payments_graph, "s12_e", lambda g: g.E().element_map().select("id", "label", "src", "dst"),
   "select eid id, label, src, dst from p_edge")
on(payments_graph, "s12_e_ids",
   lambda g: g.E(ids=g.edge_view(["owns"], ()).select(F.col("eid").alias("id"))).element_map()
   .select("id", "label", "src", "dst"), "select eid id, label, src, dst from p_edge where eid like 'owns#%'")


@add("s14_csv_sink", "select src, dst, amount, cents, type from p_tx")
def _s14(spark, sf):
    g, _ = _round_trip(spark, sf)
    return g.edge_view(["Transaction"]).select("src", "dst", F.col("amount").cast("double").alias("amount"),
                                               "cents", "type")


on(payments_graph, "s16_nodes", lambda g: export.nodes(g).select("id", "label", "type"),
   "select id, name as label, 'User' type from p_user union all select id, accountid, 'Account' from p_account")
on(payments_graph, "s16_links", lambda g: export.links(g, style="numbered"),
   """select eid id, src source, dst target, 'owns' type, 'owns' as label from p_owns union all
 select eid, src, dst, 'Transaction', concat('$', eid, '->', amount::varchar) from p_tx""")

_OUT_PATHS = """select src from p_tx union select dst from p_tx"""
on(payments_graph, "s16_result_nodes", lambda g: export.subgraph(g, payments.user_transfer_paths(g, "out"))[0]
   .select("id", "label", "type"),
   f"""select u.id, u.name as label, 'User' type from p_user u where u.id in (select src from p_owns
 where dst in ({_OUT_PATHS})) union all select id, accountid, 'Account' from p_account where id in ({_OUT_PATHS})""")
on(payments_graph, "s16_result_links", lambda g: export.subgraph(g, payments.user_transfer_paths(g, "out"))[1]
   .select("id", "source", "target", "type"),
   f"""select eid id, src source, dst target, 'owns' type from p_owns where dst in ({_OUT_PATHS})
 union all select eid, src, dst, 'Transaction' from p_tx""")

# ---- filters ------------------------------------------------------------------

on(payments_graph, "f1_has_label", lambda g: g.V().has_label("User").ids().select("id"), "select id from p_user")
on(fraud_graph, "f2_has", lambda g: g.V("Person").has("fraud_flag", True).ids().select("id"),
   "select id from v_person where fraud_flag")
on(fraud_graph, "f3_has_label_key", lambda g: g.V().has_label_key("BankAccount", "bank", "BUILDING").ids().select("id"),
   "select id from v_account where bank = 'BUILDING'")
on(payments_graph, "f4_has_gte", lambda g: g.E("Transaction").has("amount", gte(250000.0)).element_map("amount")
   .select("id", "amount"), "select eid id, amount from p_tx where amount >= 250000")
on(payments_graph, "f5_has_id", lambda g: g.V("Account").out("Transaction").has_id(neq("A1")).count(),
   """select a.id seed, count(t.eid) n from p_account a left join p_tx t on t.src = a.id and t.dst <> 'A1'
 group by 1""")
on(payments_graph, "f5_has_id_many",
   lambda g: g.V("User").out("owns").out("Transaction")
   .has_id(g.V("Account").has("balance", lambda c: c < 0).ids().select("id")).count(),
   """select u.id seed, count(t.eid) n from p_user u join p_owns o on o.src = u.id left join
 (select t.* from p_tx t join p_account a on a.id = t.dst and a.balance < 0) t on t.src = o.dst group by 1""")
on(payments_graph, "f6_display_labels", lambda g: g.edge_view(None, ["amount"]).select(
    "eid", link_label(["amount"]).alias("text")).unionByName(
    g.vertex_view().select(F.col("id").alias("eid"), node_label(["name", "accountId"]).alias("text"))),
   """select eid, case when eid like 'T%' then concat('T->$', amount::varchar) else 'owns' end as text from
 (select eid, amount from p_tx union all select eid, null from p_owns) union all
 select id, name from p_user union all select id, accountid from p_account""")
on(payments_graph, "f7_where", lambda g: g.V("User").out("owns").out_e("Transaction").where(
    lambda f: f.in_v().in_("owns").has("age", gte(60))).element_map().select("seed", "id"),
   """select o.src seed, t.eid id from p_owns o join p_tx t on t.src = o.dst where t.dst in
 (select o2.dst from p_owns o2 join p_user u on u.id = o2.src where u.age >= 60)""")
on(payments_graph, "f8_exists", lambda g: g.V("Account").out_e("Transaction").has("amount", gte(400000.0)).exists(),
   "select id seed, id in (select src from p_tx where amount >= 400000) found from p_account")
on(payments_graph, "f9_simple_path",
   lambda g: g.V("User").with_path().out("owns").out("Transaction").in_("owns").simple_path().count(),
   """select u.id seed, count(p.src) n from p_user u left join (select o.src from p_owns o join p_tx t on t.src = o.dst
 join p_owns o2 on o2.dst = t.dst where o2.src <> o.src and t.dst <> o.dst) p on p.src = u.id group by 1""")
on(fraud_graph, "f10_edge_filter", lambda g: g.V("VPA").out_e("transaction").has("fraud_flag", True).in_v().ids()
   .select("seed", "id"), "select src seed, dst id from e_tx where fraud_flag")
on(payments_graph, "f11_name_search", lambda g: g.V("User").name_contains("CUSTOMER#00000001").ids().select("id"),
   "select id from p_user where lower(name) like '%customer#00000001%'")

# ---- hops ---------------------------------------------------------------------

on(fraud_graph, "h1_out", lambda g: g.V("Person").out(*fraud.HAS).out("owns").out("transaction").ids()
   .select("seed", "id"), "select pv.person seed, t.dst id from pv join e_tx t on t.src = pv.vpa")
on(fraud_graph, "h2_in", lambda g: g.V("VPA").in_("owns").in_(*fraud.HAS).ids().select("seed", "id"),
   "select o.dst seed, h.src id from e_owns o join e_has h on h.dst = o.src")
on(payments_graph, "h3_out_e", lambda g: g.V("Account").out_e("Transaction").element_map("amount"),
   "select src seed, eid id, 'Transaction' label, src, dst, amount from p_tx")
on(payments_graph, "h4_in_e", lambda g: g.V("Account").in_e("Transaction").element_map("type"),
   "select dst seed, eid id, 'Transaction' label, src, dst, type from p_tx")
on(payments_graph, "h5_both_e", lambda g: g.V("Account").both_e().ids().select("seed", "id", "label"),
   """select k seed, b.eid id, case when b.eid like 'owns#%' then 'owns' else 'Transaction' end as label
 from p_both b where k like 'A%'""")
on(payments_graph, "h6_in_v_out_v", lambda g: g.V("User").out("owns").in_e("Transaction").out_v().ids()
   .select("seed", "id"), "select o.src seed, t.src id from p_owns o join p_tx t on t.dst = o.dst")
on(payments_graph, "h7_other_v", lambda g: g.V("Account").both_e("Transaction").other_v().ids().select("seed", "id"),
   "select src seed, dst id from p_tx union all select dst, src from p_tx")
on(food_graph, "h8_vertex_fetch", lambda g: g.V("CustomerProfile").out("PLACED").value_map("order_date", "status"),
   "select p.src seed, o.order_date, o.status from f_placed p join f_order o on o.id = p.dst")
on(food_graph, "h9_goto", lambda g: g.V("FoodOrder").as_("order").goto(
    g.edge_view(["DELIVERED_BY"], ()).select(F.col("src").alias("seed"), F.col("dst").alias("id")), ["Driver"])
   .as_("driver").select("order", "driver"), """select src seed, src "order", dst driver from f_delivered_by""")
on(payments_graph, "h10_path_elements", lambda g: g.V(ids=orders.path_elements(
    payments.user_transfer_paths(g, "out")).filter("kind = 'v'").select("id")).ids().select("id", "label"),
   """select distinct id, label from (select u.id, 'User' label from p_user u where u.id in (select o.src from p_owns o
 join p_tx t on t.src = o.dst join p_owns o2 on o2.dst = t.dst) or u.id in (select o2.src from p_owns o
 join p_tx t on t.src = o.dst join p_owns o2 on o2.dst = t.dst) union all select a.id, 'Account' from p_account a
 where a.id in (select src from p_tx) or a.id in (select dst from p_tx))""")


@add("h1_out_salted", "select o.src seed, t.dst id from p_owns o join p_tx t on t.src = o.dst")
def _h1s(spark, sf):
    """Hops with the busiest accounts salted: same rows as the plain join."""
    g = payments_graph(spark, sf)
    hot = skew.supernodes(g.edge_view(["Transaction"], ()), 15)
    g = g.with_supernodes(hot, salts=4)
    return g.V("User").out("owns").out("Transaction").ids().select("seed", "id")


on(payments_graph, "f10_absent_property", lambda g: g.E("owns").has("cents", lambda c: c > 0).ids().select("id")
   .unionByName(g.E("Transaction").has("cents", lambda c: c > 0).ids().select("id")),
   "select eid id from p_tx where cents > 0")
on(payments_graph, "r3_frontier_repeat", lambda g: g.V("User").repeat(lambda f: f.out(), 2).ids().select("seed", "id"),
   "select o.src seed, t.dst id from p_owns o join p_tx t on t.src = o.dst")
on(payments_graph, "a3_frontier_mean", lambda g: g.V("User").out("owns").out_e("Transaction").mean("cents")
   .select("seed", F.round("mean", 4).alias("mean")),
   "select o.src seed, round(avg(t.cents), 4) as mean from p_owns o join p_tx t on t.src = o.dst group by 1")

# ---- projections --------------------------------------------------------------

on(fraud_graph, "p1_values", lambda g: g.V("Person").out("has_account").values("bank").select("seed", "value"),
   "select h.src seed, a.bank as value from e_has_account h join v_account a on a.id = h.dst")
on(payments_graph, "p2_all_values", lambda g: g.V("User").properties().select("id", "value"),
   """select id, userid as value from p_user union all select id, name from p_user union all
 select id, age::varchar from p_user""")
on(food_graph, "p3_value_map", lambda g: g.V("Restaurant").in_e("RATED").value_map("rating", "comment", as_map=True)
   .select("seed", F.element_at(F.col("value_map")["rating"], 1).alias("rating"),
           F.element_at(F.col("value_map")["comment"], 1).alias("comment")),
   "select dst seed, rating::varchar rating, comment from f_rated")
on(fraud_graph, "p4_value_map_tokens", lambda g: g.V("BankAccount").value_map("bank", tokens=True)
   .select("id", "label", "bank"), "select id, 'BankAccount' label, bank from v_account")
on(payments_graph, "p5_element_map", lambda g: g.E("Transaction").element_map("amount", "type")
   .select("id", "label", "src", "dst", "amount", "type"),
   "select eid id, 'Transaction' label, src, dst, amount, type from p_tx")
on(payments_graph, "p6_properties", lambda g: g.V("User").properties().select("id", "key", "value"),
   """select id, 'userId' as key, userid as value from p_user union all select id, 'name', name from p_user union all
 select id, 'age', age::varchar from p_user""")
on(food_graph, "p7_project", orders.order_items,
   """select o.id order_id, coalesce(o.status, 'Unknown') status, l.item, l.qty, l.price from f_order o left join
 (select c.src, i.name item, c.qty, i.price from f_contains c join f_item i on i.id = c.dst) l on l.src = o.id""")
on(payments_graph, "p8_select_tags", payments.outgoing_transfers,
   """select o.src seed, t.amount, a.accountid receiver from p_owns o join p_tx t on t.src = o.dst
 join p_account a on a.id = t.dst""")
on(fraud_graph, "p9_id_label", lambda g: g.V().ids().select("id", "label"),
   """select id, 'Person' label from v_person union all select id, 'BankAccount' from v_account union all
 select id, 'Card' from v_card union all select id, 'VPA' from v_vpa union all
 select distinct dst, 'Device' from e_dev""")
on(payments_graph, "p10_constant", lambda g: g.V("User").value_map("name", tokens=True).select(
    "id", F.col("name").alias("label"), F.lit("user").alias("type")), "select id, name as label, 'user' type from p_user")
on(payments_graph, "p11_coalesce", lambda g: payments.total_outgoing(g, "zero"),
   "select accountid \"accountId\", total_cents from p_totals")

# ---- paths ----------------------------------------------------------------------

on(fraud_graph, "r1_path", lambda g: _text_path(fraud.outgoing_paths(g), "seed"),
   """select h.src seed, concat_ws('>', h.src, h.eid, h.dst, o.eid, o.dst, t.eid, t.dst) path from e_has h
 join e_owns o on o.src = h.dst join e_tx t on t.src = o.dst""")
on(fraud_graph, "r1_path_vertices", lambda g: _text_path(
    g.V("Person").with_path().out(*fraud.HAS).out("owns").paths(), "seed"),
   "select h.src seed, concat_ws('>', h.src, h.dst, o.dst) path from e_has h join e_owns o on o.src = h.dst")
on(payments_graph, "r2_path_ids", lambda g: _text_path(g.V("User").with_path().out_e("owns").in_v().paths(), "seed"),
   "select src seed, concat_ws('>', src, eid, dst) path from p_owns")
on(payments_graph, "r3_repeat", lambda g: messages.total_per_seed(
    g.V("Account").df.select("seed"), messages.walk_counts(g.edge_view(["Transaction"], ()), 2), ["n"]),
   """select a.id seed, count(p.s) n from p_account a left join (select t.src s from p_tx t join p_tx t2
 on t2.src = t.dst) p on p.s = a.id group by 1""")
on(food_graph, "r4_local_limit", lambda g: g.V("CustomerProfile").both_e(cap=5).other_v().ids().select("seed", "id"),
   "select c.id seed, x.f id from f_customer c join f_capped x on x.k = c.id")


def _walks(g):
    seeds = g.vertices["CustomerProfile"].select(F.col("id").alias("seed"))
    return orders.neighbourhood(g, seeds, "CustomerProfile", 2, per_hop=5, max_paths=150).paths()


on(food_graph, "r5_path_cap", lambda g: _text_path(_walks(g), "seed"),
   "select seed, array_to_string(path, '>') path from f_walk")
on(food_graph, "r5_global_cap", lambda g: _text_path(orders.first_walks(
    g, g.vertices["CustomerProfile"].select(F.col("id").alias("seed")), "CustomerProfile", 2, 150, per_hop=5), "seed"),
   "select seed, array_to_string(path, '>') path from f_walk order by f_walk.seed, f_walk.path limit 150")
on(food_graph, "r6_path_sets", lambda g: orders.path_elements(_walks(g)),
   """select distinct seed, kind, id from (select seed, unnest(path) id, unnest(['v', 'e', 'v', 'e', 'v']) kind
 from f_walk)""")
on(fraud_graph, "r7_local_group", lambda g: g.V("VPA").out_e("transaction").values("cents").groupBy("seed").agg(
    F.min("value").alias("low"), F.max("value").alias("high")),
   "select src seed, min(cents) low, max(cents) high from e_tx group by 1")

# ---- aggregates -----------------------------------------------------------------

on(payments_graph, "a1_count", lambda g: g.V("Account").out_e("Transaction").count(),
   "select a.id seed, count(t.eid) n from p_account a left join p_tx t on t.src = a.id group by 1")
on(payments_graph, "a2_sum", lambda g: g.V("Account").out_e("Transaction").sum("cents"),
   "select src seed, cast(sum(cents) as bigint) total from p_tx group by 1")


def _receivers_mean(g):
    """Mean amount sent on by an account's receivers: per-vertex sums pulled one hop back."""
    e = g.edge_view(["Transaction"], ["cents"])
    own = e.groupBy(F.col("src").alias("id")).agg(F.sum("cents").alias("total"), F.count("*").alias("n"))
    return messages.pull(e, own, ["total", "n"]).select(
        F.col("id").alias("seed"), C.mean_of_cents(F.col("total"), F.col("n")).alias("mean"))


on(payments_graph, "a3_mean", _receivers_mean,
   """select t.src seed, cast(sum(t2.cents) as double) / cast(count(*) as double) / cast(100 as double) mean
 from p_tx t join p_tx t2 on t2.src = t.dst group by 1""")
on(payments_graph, "a4_group_sum", payments.total_outgoing,
   "select src \"accountId\", cast(sum(cents) as bigint) total_cents from p_tx group by 1")
on(fraud_graph, "a5_group_mean", lambda g: fraud.sender_totals(g).select(
    "id", C.mean_of_cents(F.col("tx_cents"), F.col("tx_n")).alias("mean")),
   """select src id, cast(sum(cents) as double) / cast(count(*) as double) / cast(100 as double) mean
 from e_tx group by 1""")
on(payments_graph, "a6_list_total", payments.in_out_totals,
   """select u.id seed, coalesce((select sum(t.cents) from p_tx t join p_owns o on o.dst = t.src
 where o.src = u.id), 0)::bigint out_cents, coalesce((select sum(t.cents) from p_tx t join p_owns o on o.dst = t.dst
 where o.src = u.id), 0)::bigint in_cents from p_user u""")
on(food_graph, "a7_label_counts", lambda g: g.vertex_view(None, ()).groupBy("label").agg(F.count("*").alias("n")),
   """select 'CustomerProfile' label, count(*) n from f_customer union all select 'Restaurant', count(*)
 from f_restaurant union all select 'MenuItem', count(*) from f_item union all select 'Driver', count(*) from f_driver
 union all select 'FoodOrder', count(*) from f_order""")
on(payments_graph, "a8_multiplicity", payments.pair_multiplicity,
   "select least(src, dst) lo, greatest(src, dst) hi, count(*) n from p_tx group by 1, 2")
_FENCE = """, r as (select total_cents t, row_number() over (order by total_cents desc, id) rn,
 count(*) over () n from p_totals), q as (select max(case when rn = floor(n / 4.0) + 1 then t end) q3,
 max(case when rn = ceil(3 * n / 4.0) + 1 then t end) q1 from r)"""


def _fence_sql(tail: str) -> str:
    body = with_views("select 1 from p_totals, p_owns, p_user")
    return body[: body.rindex("\nselect 1")] + _FENCE + "\n" + tail


_MEAN = """(select cast(sum(t) as double) / cast(count(*) as double) from r cross join q
 where t between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))"""


@add("a9_fenced_mean")
def _a9(spark, sf):
    totals = materialize(payments.account_totals(payments_graph(spark, sf)).select("total_cents"), "totals")
    return payments.fenced_stats(totals, "total_cents")


SQL["a9_fenced_mean"] = _fence_sql(f"select (select count(*) from r) n, q1, q3, {_MEAN} mean from q")

# ---- order, limit, sample, dedup -------------------------------------------------

on(payments_graph, "l1_order_limit", lambda g: g.vertices["Account"].orderBy(F.desc("balance"), "id").limit(100)
   .select("id", "balance"), "select id, balance from p_account order by balance desc, id limit 100")
on(food_graph, "l2_limit", orders.restaurant_ratings,
   """select restaurant, eid, rating, comment from (select dst restaurant, eid, rating, comment,
 row_number() over (partition by dst order by eid) rn from f_rated) where rn <= 10""")
on(food_graph, "l3_top_per_group", lambda g: _big(orders.recent_orders(g, 3), "rank"),
   """select src customer, rank, dst order_id, order_date, coalesce(status, 'Unknown') status from (select p.src, p.dst,
 o.order_date, o.status, row_number() over (partition by p.src order by o.order_date desc, o.id) rank
 from f_placed p join f_order o on o.id = p.dst) where rank <= 3""")
on(payments_graph, "l4_rank_top", lambda g: payments.top_accounts(g, 25).select("id", "total_cents"),
   "select id, total_cents from p_totals order by total_cents desc, id limit 25")
_U = "cast(concat('0x', substr(md5(concat('{0}|', {1})), 1, 13)) as bigint)::double / 4503599627370496.0"
on(payments_graph, "l5_sample", lambda g: orders.sample_exact(g.vertices["Account"], 50, "id", 7, "md5").select("id"),
   f"select id from p_account order by {_U.format('7|sample', 'id')}, id limit 50")
on(payments_graph, "l6_dedup", lambda g: g.V("Account").out("Transaction").dedup().ids().select("seed", "id"),
   "select distinct src seed, dst id from p_tx")
on(payments_graph, "l7_dedup_rows", lambda g: g.edge_view(None, ()).select("src", "dst", "label").distinct(),
   "select distinct src, dst, label from p_edge")

# ---- updates ------------------------------------------------------------------------

on(payments_graph, "m1_add_vertices", lambda g: update.add_vertices(g, "User", g.vertices["Account"].select(
    F.concat(F.lit("N"), "id").alias("id"), F.col("accountId").alias("name"))).vertices["User"].select("id", "name"),
   "select id, name from p_user union all select concat('N', id), accountid from p_account")
on(payments_graph, "m2_add_edges", lambda g: update.add_edges(g, "owns", g.edge_view(["Transaction"], ()).select(
    F.concat(F.lit("n"), "eid").alias("eid"), F.concat(F.lit("U"), F.substring("src", 2, 20)).alias("src"),
    F.concat(F.lit("A"), F.substring("dst", 2, 20).cast("bigint") * 2).alias("dst")), "User", "Account")
   .edge_view(["owns"], ()).select("eid", "src", "dst"),
   """select eid, src, dst from p_owns union all select concat('nT', k), concat('U', a), concat('A', b * 2) from tx0
 where concat('A', b * 2) in (select id from p_account)""")
on(payments_graph, "m3_add_by_key", lambda g: update.add_edges_by_key(
    g, "knows", g.vertices["User"].select(F.col("userId").alias("u"), F.concat(F.lit("A"), F.expr(
        "cast(substring(userId, 2, 20) as bigint) + 1")).alias("a")), ("User", "userId"), ("Account", "accountId"), "u", "a")
   .edge_view(["knows"], ()).select("src", "dst"),
   """select u.id src, a.id dst from p_user u join p_account a
 on a.accountid = concat('A', cast(substr(u.userid, 2) as bigint) + 1)""")
on(food_graph, "m4_set_property", lambda g: update.set_property(g, "FoodOrder", g.edge_view(["DELIVERED_BY"], ())
   .select(F.col("src").alias("id"), F.concat(F.lit("WITH_"), "dst").alias("status")), "status")
   .vertices["FoodOrder"].select("id", "status"),
   """select o.id, coalesce(concat('WITH_', d.dst), o.status) status
 from f_order o left join f_delivered_by d on d.src = o.id""")


def _dated(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.coalesce("assigned_date", F.lit(0)).alias("assigned_date"))


def _assignments(g):
    return g.vertices["FoodOrder"].filter(F.col("status") == "O").select(
        F.col("id").alias("order_id"),
        F.concat(F.lit("driver_"), F.substring("id", 7, 20).cast("bigint") % 60).alias("driver_id"),
        F.lit(1_700_000_000).cast("bigint").alias("assigned_date"))


_ASSIGNED = """(select o.id order_id, concat('driver_', cast(substr(o.id, 7) as bigint) % 60) driver_id from f_order o
 where o.status = 'O' and concat('driver_', cast(substr(o.id, 7) as bigint) % 60) in (select id from f_driver))"""
on(food_graph, "m5_assign_driver", lambda g: _dated(update.assign_drivers(g, _assignments(g)).edge_view(
    ["DELIVERED_BY"], ["assigned_date"])),
   f"""select src, dst, 0::bigint assigned_date from f_delivered_by union all
 select order_id, driver_id, 1700000000 from {_ASSIGNED}""")
on(food_graph, "m5_assign_driver_replace", lambda g: _dated(update.assign_drivers(
    g, _assignments(g), replace_old=True).edge_view(["DELIVERED_BY"], ["assigned_date"])),
   f"""select src, dst, 0::bigint assigned_date from f_delivered_by where src not in (select order_id from {_ASSIGNED})
 union all select order_id, driver_id, 1700000000 from {_ASSIGNED}""")
on(food_graph, "m5_order_status", lambda g: update.assign_drivers(g, _assignments(g)).vertices["FoodOrder"]
   .select("id", "status"), f"""select id, case when id in (select order_id from {_ASSIGNED})
 then 'ASSIGNED_TO_DRIVER' else status end status from f_order""")
on(payments_graph, "m6_drop_vertices", lambda g: update.drop_vertices(
    g, g.vertices["Account"].filter(F.col("balance") < 0).select("id")).edge_view(None, ()).select("eid", "src", "dst"),
   """select eid, src, dst from p_edge where src not in (select id from p_account where balance < 0)
 and dst not in (select id from p_account where balance < 0)""")

# ---- payments analyses ---------------------------------------------------------------

on(payments_graph, "q1_outgoing", payments.outgoing_transfers,
   """select o.src seed, t.amount, a.accountid receiver from p_owns o join p_tx t on t.src = o.dst
 join p_account a on a.id = t.dst""")
on(payments_graph, "q2_total_outgoing", payments.total_outgoing,
   "select src \"accountId\", cast(sum(cents) as bigint) total_cents from p_tx group by 1")
on(payments_graph, "q3_senders_to_user", lambda g: payments.senders_to_user(g, 100000.0),
   """select o.src seed, u.name sender from p_owns o join p_tx t on t.dst = o.dst and t.amount >= 100000
 join p_owns o2 on o2.dst = t.src join p_user u on u.id = o2.src""")
on(payments_graph, "q4_user_properties", lambda g: payments.user_properties(g).select("id", "key", "value"),
   """select id, 'userId' as key, userid as value from p_user union all select id, 'name', name from p_user union all
 select id, 'age', age::varchar from p_user""")


def _user_pairs(g):
    """Ordered user pairs taken from the transfers themselves."""
    def user(c):
        return F.concat(F.lit("U"), F.substring(c, 2, 20))
    return g.edge_view(["Transaction"], ()).select(user("src").alias("a"), user("dst").alias("b")).distinct()


_PAIRS = "(select distinct concat('U', a) a, concat('U', b) b from tx0)"
on(payments_graph, "q5_between_users", lambda g: payments.transfers_between(g, _user_pairs(g), True)
   .select("a", "b", "eid", "amount"),
   f"""select p.a, p.b, t.eid, t.amount from {_PAIRS} p join p_owns oa on oa.src = p.a join p_owns ob on ob.src = p.b
 join (select src x, dst y, eid, amount from p_tx union all select dst, src, eid, amount from p_tx) t
 on t.x = oa.dst and t.y = ob.dst""")
on(payments_graph, "q6_counterparties", payments.counterparties,
   """select distinct o.src seed, u.name from p_owns o join (select src x, dst y from p_tx union all
 select dst, src from p_tx) t on t.x = o.dst join p_owns o2 on o2.dst = t.y join p_user u on u.id = o2.src""")
on(payments_graph, "q6_all_names", payments.all_names, "select name from p_user")
on(payments_graph, "q7_in_out_totals", payments.in_out_totals,
   """select u.id seed, coalesce(o.s, 0)::bigint out_cents, coalesce(i.s, 0)::bigint in_cents from p_user u
 left join (select o.src, sum(cents) s from p_owns o join p_tx t on t.src = o.dst group by 1) o on o.src = u.id
 left join (select o.src, sum(cents) s from p_owns o join p_tx t on t.dst = o.dst group by 1) i on i.src = u.id""")
for _name, _pattern, _last in (("q8_between_both", ("out", "both", "both"), "p_both"),
                               ("q8_between_in", ("out", "both", "in"), "(select eid, dst k, src f from p_edge)")):
    on(payments_graph, _name,
       lambda g, pattern=_pattern: _text_path(payments.paths_between(g, _user_pairs(g), pattern), "a", "b"),
       f"""select p.a, p.b, concat_ws('>', p.a, x.eid, x.dst, y.eid, y.f, z.eid, z.f) path from {_PAIRS} p
 join p_edge x on x.src = p.a join p_both y on y.k = x.dst join {_last} z on z.k = y.f and z.f = p.b where p.a <> p.b""")
for _name, _dir, _mid in (("q9_user_subgraph_out", "out", "(select eid, src k, dst f from p_edge)"),
                          ("q9_user_subgraph_in", "in", "(select eid, dst k, src f from p_edge)")):
    on(payments_graph, _name, lambda g, d=_dir: _text_path(payments.user_transfer_paths(g, d), "seed"),
       f"""select x.src seed, concat_ws('>', x.src, x.eid, x.dst, y.eid, y.f, z.eid, z.f) path from p_edge x
 join {_mid} y on y.k = x.dst join p_both z on z.k = y.f join p_user e on e.id = z.f
 where x.src in (select id from p_user)""")
on(payments_graph, "q10_rank_accounts", payments.rank_accounts,
   """select a.id, a.accountid "accountId", a.total_cents, o.src owner_id, u.name as owner from p_totals a
 left join p_owns o on o.dst = a.id left join p_user u on u.id = o.src""")
on(payments_graph, "q11_suspected_hub", payments.suspected_hub)
SQL["q11_suspected_hub"] = _fence_sql(
    f"""select a.accountid "accountId", u.name as owner, a.total_cents, cast(a.total_cents as double) / {_MEAN} increase
 from p_totals a join p_owns o on o.dst = a.id join p_user u on u.id = o.src order by a.total_cents desc, a.id limit 1""")

# ---- fraud checks ----------------------------------------------------------------------


def checked(name: str, fn, sql: str) -> None:
    add(name, sql)(lambda spark, sf: fn(fraud_graph(spark, sf), payment_requests(spark, sf)))


checked("q12_paid_before", fraud.paid_before,
        """select payment, exists (select 1 from e_tx t where t.src = req.vpa and t.dst = req.target) known from req""")
checked("q13_sender_paths", lambda g, r: _text_path(fraud.sender_paths(g, r), "vpa", "target"),
        """select r.vpa, r.target, concat_ws('>', r.vpa, o.src, h.src, h2.eid, h2.dst, o2.eid, o2.dst, t.eid, t.dst) path
 from (select distinct vpa, target from req) r join e_owns o on o.dst = r.vpa join e_has_account h on h.dst = o.src join e_has h2 on h2.src = h.src
 join e_owns o2 on o2.src = h2.dst join e_tx t on t.src = o2.dst and t.dst = r.target""")
on(fraud_graph, "q13_all_paths", lambda g: _text_path(fraud.outgoing_paths(g), "seed"),
   """select h.src seed, concat_ws('>', h.src, h.eid, h.dst, o.eid, o.dst, t.eid, t.dst) path from e_has h
 join e_owns o on o.src = h.dst join e_tx t on t.src = o.dst""")
checked("q14_known_beneficiary", fraud.known_beneficiary,
        """select r.payment, k.person is not null known from req r left join known k
 on k.person = r.person and k.receiver = r.target""")
checked("q15_second_degree", fraud.second_degree,
        """select r.payment, count(t.eid) n_paths from req r left join known k on k.person = r.person
 left join e_tx t on t.src = k.receiver and t.dst = r.target group by 1""")
on(fraud_graph, "q16_velocity_vpa", fraud.velocity_per_vpa,
   """select pv.person, pv.vpa, cast(sum(cents) as double) / cast(count(*) as double) / cast(100 as double) mean_amount
 from (select distinct person, vpa from pv) pv join e_tx t on t.src = pv.vpa group by 1, 2""")
on(fraud_graph, "q17_velocity_all", fraud.velocity_per_person,
   """select pv.person, cast(sum(cents) as double) / cast(count(*) as double) / cast(100 as double) mean_amount
 from pv join e_tx t on t.src = pv.vpa group by 1""")
on(fraud_graph, "q18_devices", fraud.devices, "select src person, dst device from e_dev")
on(fraud_graph, "q19_shared_devices", fraud.shared_devices,
   "select dst device, count(*) n_persons from e_dev group by 1 having count(*) > 1")
on(fraud_graph, "q20_cities", fraud.cities_immediate,
   "select distinct pv.person, t.ip_city from pv join e_tx t on t.src = pv.vpa")
on(fraud_graph, "q21_cities_extended", fraud.cities_extended,
   """select distinct pv.person, t2.ip_city from pv join e_tx t on t.src = pv.vpa join e_tx t2 on t2.src = t.dst""")


def _counted(inner: str) -> str:
    return (f"select p.id person, count(x.person) n from v_person p left join ({inner}) x "
            "on x.person = p.id group by 1")


_Q22 = "select h.src person from e_has h join v_instrument i on i.id = h.dst and i.fraud_block"
_Q23 = """select pv.person from pv join e_tx t on t.src = pv.vpa join e_owns o on o.dst = t.dst
 join v_instrument i on i.id = o.src and i.fraud_block"""
_Q24 = """select pv.person from pv join e_tx t on t.src = pv.vpa join e_owns o on o.dst = t.dst
 join e_has h on h.dst = o.src join v_person p on p.id = h.src and p.fraud_flag"""
_Q25 = "select pv.person from pv join e_tx t on t.src = pv.vpa and t.fraud_flag"
_Q26 = """select pv.person from pv join e_tx t on t.src = pv.vpa join e_tx t2 on t2.src = t.dst and t2.fraud_flag"""
on(fraud_graph, "q22_blocked", fraud.blocked_immediate, _counted(_Q22))
on(fraud_graph, "q23_blocked_extended", fraud.blocked_extended, _counted(_Q23))
on(fraud_graph, "q24_flagged_persons", fraud.flagged_persons_extended, _counted(_Q24))
on(fraud_graph, "q25_flagged_tx", fraud.flagged_tx_immediate, _counted(_Q25))
on(fraud_graph, "q26_flagged_tx_extended", fraud.flagged_tx_extended, _counted(_Q26))

# ---- orders ------------------------------------------------------------------------------

on(food_graph, "q27_order_items", orders.order_items,
   """select o.id order_id, coalesce(o.status, 'Unknown') status, l.item, l.qty, l.price from f_order o left join
 (select c.src, i.name item, c.qty, i.price from f_contains c join f_item i on i.id = c.dst) l on l.src = o.id""")
_RECENT = """(select p.src customer, o.id order_id, o.order_date, coalesce(o.status, 'Unknown') status,
 row_number() over (partition by p.src order by o.order_date desc, o.id) rank from f_placed p join f_order o on o.id = p.dst)"""
on(food_graph, "q28_latest_order", orders.latest_order,
   f"select customer, order_id, order_date, status from {_RECENT} where rank = 1")
on(food_graph, "q29_recent_orders", lambda g: _big(orders.recent_orders(g), "rank"),
   f"select customer, rank, order_id, order_date, status from {_RECENT} where rank <= 5")
on(food_graph, "q30_ratings", orders.restaurant_ratings,
   """select restaurant, eid, rating, comment from (select dst restaurant, eid, rating, comment,
 row_number() over (partition by dst order by eid) rn from f_rated) where rn <= 10""")
on(food_graph, "q31_random_ids", lambda g: orders.random_ids(
    g, ["CustomerProfile", "FoodOrder", "Restaurant", "Driver"], 20, 11, "md5"),
   f"""select label, id from (select label, id, row_number() over (partition by label
 order by {_U.format('11|sample', 'id')}, id) rn from (select 'CustomerProfile' label, id from f_customer union all
 select 'FoodOrder', id from f_order union all select 'Restaurant', id from f_restaurant union all
 select 'Driver', id from f_driver)) where rn <= 20""")
on(food_graph, "q32_neighbourhood", lambda g: orders.path_elements(_walks(g)),
   """select distinct seed, kind, id from (select seed, unnest(path) id, unnest(['v', 'e', 'v', 'e', 'v']) kind
 from f_walk)""")
on(payments_graph, "q33_full_nodes", lambda g: export.nodes(g).select("id", "label", "type"),
   "select id, name as label, 'User' type from p_user union all select id, accountid, 'Account' from p_account")
on(payments_graph, "q33_full_links", lambda g: export.links(g).select("id", "source", "target", "type"),
   "select eid id, src source, dst target, label as type from p_edge")
_N = "select p.id person, {0} n from v_person p left join {1} x on x.person = p.id group by 1"
on(fraud_graph, "q36_risk_features", fraud.risk_features,
   f"""select p.id person, coalesce(kr.n, 0) known_receivers, coalesce(tx.n, 0) tx_n, tx.mean_amount,
 coalesce(dv.n, 0) devices, coalesce(dv.s, 0) shared_devices, coalesce(c1.n, 0) cities, coalesce(c2.n, 0) cities_ext,
 coalesce(q22.n, 0) blocked, coalesce(q23.n, 0) blocked_ext, coalesce(q24.n, 0) flagged_persons_ext,
 coalesce(q25.n, 0) flagged_tx, coalesce(q26.n, 0) flagged_tx_ext from v_person p
 left join (select person, count(*) n from known group by 1) kr on kr.person = p.id
 left join (select pv.person, count(*) n, cast(sum(cents) as double) / cast(count(*) as double) / cast(100 as double)
 mean_amount from pv join e_tx t on t.src = pv.vpa group by 1) tx on tx.person = p.id
 left join (select d.src person, count(*) n, count(*) filter (s.dst is not null) s from e_dev d left join
 (select dst from e_dev group by 1 having count(*) > 1) s on s.dst = d.dst group by 1) dv on dv.person = p.id
 left join (select pv.person, count(distinct t.ip_city) n from pv join e_tx t on t.src = pv.vpa group by 1) c1
 on c1.person = p.id
 left join (select pv.person, count(distinct t2.ip_city) n from pv join e_tx t on t.src = pv.vpa
 join e_tx t2 on t2.src = t.dst group by 1) c2 on c2.person = p.id
 left join (select person, count(*) n from ({_Q22}) group by 1) q22 on q22.person = p.id
 left join (select person, count(*) n from ({_Q23}) group by 1) q23 on q23.person = p.id
 left join (select person, count(*) n from ({_Q24}) group by 1) q24 on q24.person = p.id
 left join (select person, count(*) n from ({_Q25}) group by 1) q25 on q25.person = p.id
 left join (select person, count(*) n from ({_Q26}) group by 1) q26 on q26.person = p.id""")

# ---- generators, sized by the tables ---------------------------------------------------------

YARD_GRAPH = {
    "vertices": {
        "Berth": {"percent": 15, "properties": {
            "depth": {"type": "Double", "min": -21.5, "max": -4.25}, "roofed": {"type": "Bool", "true_chance": 12}}},
        "Crane": {"percent": 30, "properties": {
            "tag": {"type": "String", "min_size": 6, "max_size": 6, "allowed_chars": "KLMNPQ"}}},
        "Box": {"percent": 55, "properties": {
            "kilos": {"type": "Int", "min": 1200, "max": 30400},
            "seal": {"type": "Long", "min": -4 * 10 ** 18, "max": 5 * 10 ** 18},
            "landed": {"type": "Date", "min_year": 2011, "max_year": 2019}}}},
    "edges": {"SERVES": {"crane_at_berth": {"from": "Crane", "to": "Berth", "properties": {
        "shift": {"type": "Int", "min": 1, "max": 3}}}},
        "LIFTS": {"crane_lifts_box": {"from": "Crane", "to": "Box", "properties": {}}},
        "STACKED_ON": {"box_on_box": {"from": "Box", "to": "Box", "properties": {}}}}}
CLUB_GRAPH = {
    "EgoNode": {"label": "Member", "properties": {
        "rank": {"generator": "pyint(min_value=10, max_value=40)", "type": "int"}},
        "connections": {"Circle": {"degree": {"dist": "poisson", "lam": 1.8, "min": 1, "max": 7}},
                        "Medal": {"degree": {"dist": "normal", "mean": 2.2, "sigma": 1.1, "max": 6}}}},
    "AlterNodes": {
        "Circle": {"label": "Circle", "properties": {"open": {"generator": "pybool(70)", "type": "bool"}},
                   "connections": {"Medal": {"degree": {"dist": "uniform", "low": 0, "high": 5}, "properties": {
                       "weight": {"generator": "pyfloat(min_value=0, max_value=9)", "type": "double"}}}}},
        "Medal": {"label": "Medal", "properties": {
            "metal": {"generator": "random_element(elements=['tin', 'brass', 'steel'])", "type": "string"}}}}}


def _n(spark, sf, name="customer") -> int:
    return table(spark, sf, name).count()


def _numbers(spark, sf, name="customer", key="c_custkey", first=1):
    """The table's keys as numbers ``n`` from ``first``; the keys of these tables have no gaps."""
    keys = table(spark, sf, name).select(F.col(key).cast("bigint").alias("n"))
    return keys.select((F.col("n") - keys.agg(F.min("n").alias("m")).scalar() + first).alias("n"))


def _scale_free(spark, sf):
    return scale_free.generate(spark, _numbers(spark, sf, first=0), YARD_GRAPH, gamma=2.5, seed=42)


@add("g1_vertex_types", """with k as (select c_custkey - min(c_custkey) over () as i, count(*) over () as n from customer),
 t as (select case when i < floor(n * 0.15) then 'Berth' when i < floor(n * 0.15) + floor(n * 0.3) then 'Crane'
 else 'Box' end as label, i from k)
 select label, count(*) as vertices, min(i)::bigint as first_n from t group by label""")
def _g1(spark, sf):
    g = _scale_free(spark, sf)
    return g.vertex_view(None, ()).groupBy("label").agg(
        F.count("*").alias("vertices"), F.min(F.substring("id", -19, 19).cast("bigint")).alias("first_n"))


def _zipf_sql(gamma: float, stream: str = "e", most: str = "(select count(*) - 1 from customer)") -> str:
    """The inverse CDF over the driver's customers, with its table and series written out."""
    cdf, steps = gdeg.zipf_table(gamma), 2 * gdeg.SEARCH + 1
    u = _U.format(f"42|{stream}/degree", "c_custkey")
    items = ", ".join(repr(x) + "::double" for x in cdf)
    mass = " + ".join(f"({c!r}::double * pow(f + i + 1, {p!r}::double))" for c, p in gdeg.tail_terms(gamma))
    far = " + ".join(f"(select ({mass}) > l from (select {i}.0::double as i))::int" for i in range(steps))
    return f"""with a as (select c_custkey, {u} u from customer),
 b as (select *, (1.0 - u) * {float(gdeg.zeta_tail(gamma, 1.0))!r}::double l from a),
 c as (select *, greatest(floor(pow(l * {gamma - 1!r}::double, {-1 / (gamma - 1)!r}::double)) - {gdeg.SEARCH},
 {gdeg.HEAD + 1}.0)::double f from b)
 select c_custkey n, least(case when u < {cdf[-1]!r}::double then 1 + len(list_filter([{items}], lambda c: c <= u))
 else f + {far} end, {most})::bigint as degree from c"""


@add("g2_zipf_degrees", _zipf_sql(2.5))
def _g2(spark, sf):
    n = _n(spark, sf)
    return scale_free.out_degrees(table(spark, sf, "customer").select(F.col("c_custkey").alias("n")), 2.5, n, 42, "e",
                                  algo="md5")


def _targets_sql() -> str:
    """The keyed permutation over the driver's customers and parts: six rounds, walked on until inside the pool."""
    def permuted(x: str, rows: str) -> str:
        sql = f"select s, i, {x} >> half as l, {x} & ((1::bigint << half) - 1) as r, half from {rows}"
        for k in range(1, 7):
            h = f"('0x' || substr(md5(concat_ws('|', '42', 'buys/permute', s, {k}, r)), 1, 13))::bigint"
            sql = f"select s, i, r as l, xor(l, {h} & ((1::bigint << half) - 1)) as r, half from ({sql})"
        return f"select s, i, (l << half) | r as x, half from ({sql})"

    degrees = _zipf_sql(2.0, "buys", "(select count(*) - 1 from customer), (select count(*) from part)")
    return f"""with recursive pools as (
 select count(*) pool, greatest(1, (length(bin(count(*) - 1)) + 1) // 2)::int half from part),
 degs as ({degrees}),
 pairs as (select n s, unnest(range(0, degree)) i, half from degs, pools),
 walk as ({permuted('i', 'pairs')} union all
  {permuted('x', '(select w.* from walk w, pools where x >= pool)')})
 select s::bigint s, (x + (select count(*) from customer))::bigint t from walk, pools where x < pool"""


@add("g3_targets", _targets_sql())
def _g3(spark, sf):
    """Edges between customers and parts; targets of one customer are distinct."""
    c, p = _n(spark, sf), _n(spark, sf, "part")
    sources = scale_free.numbered(spark, table(spark, sf, "customer").select(F.col("c_custkey").alias("n")))
    return scale_free.target_table(sources, "buys", "C", "P", {"C": (0, c), "P": (c, c + p)}, 2.0, 42, algo="md5")


@add("g3_target_checks", """select 0::bigint repeated, 0::bigint outside, 0::bigint wrong_degree""")
def _g3c(spark, sf):
    """Violations of: distinct targets, targets inside the pool, realised degree as drawn."""
    c, p = _n(spark, sf), _n(spark, sf, "part")
    sources = scale_free.numbered(spark, table(spark, sf, "customer").select(F.col("c_custkey").alias("n")))
    e = scale_free.target_table(sources, "buys", "C", "P", {"C": (0, c), "P": (c, c + p)}, 2.0, 42)
    per = e.groupBy("s", "t").agg(F.count("*").alias("m")).groupBy("s").agg(
        F.count("*").alias("k"), F.sum(F.col("m") - 1).alias("rep"),
        F.sum(((F.col("t") < c) | (F.col("t") >= c + p)).cast("bigint")).alias("out"))
    want = scale_free.out_degrees(sources, 2.0, c, 42, "buys").select(
        "n", F.least("degree", F.lit(p).cast("bigint")).alias("d"))
    j = want.join(per, F.col("n") == F.col("s"), "left")
    return j.agg(F.coalesce(F.sum("rep"), F.lit(0)).cast("bigint").alias("repeated"),
                 F.coalesce(F.sum("out"), F.lit(0)).cast("bigint").alias("outside"),
                 F.sum((F.coalesce("k", F.lit(0)) != F.col("d")).cast("bigint")).alias("wrong_degree"))


@add("g4_out_degree", "select 0::bigint as mismatches")
def _g4(spark, sf):
    """Vertices whose stored outDegree differs from their edges."""
    g = _scale_free(spark, sf)
    real = g.edge_view(None, ()).groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("k"))
    v = g.vertex_view(None, ["outDegree"]).join(real, F.col("id") == F.col("_s"), "left")
    return v.agg(F.sum((F.coalesce("k", F.lit(0)) != F.col("outDegree")).cast("bigint")).alias("mismatches"))


def _hash_sql(stream: str, key: str = "c_custkey") -> str:
    return _U.format(f"5|{stream}", key)


@add("g5_property_values", f"""select c_custkey n, (10 + floor({_hash_sql('i')} * 90))::bigint i,
 {_hash_sql('d')} * 2.5 d, {_hash_sql('b')} < 0.35 b,
 strftime(make_date((1932 + floor({_hash_sql('t')} * 94))::bigint, (1 + floor({_hash_sql('t/month')} * 12))::bigint, 1)
 + floor({_hash_sql('t/day')} * day(last_day(make_date((1932 + floor({_hash_sql('t')} * 94))::bigint,
 (1 + floor({_hash_sql('t/month')} * 12))::bigint, 1))))::int, '%Y-%m-%d') t from customer""")
def _g5(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("n"), random_value({"type": "int", "min": 10, "max": 99}, 5, "i", k, algo="md5").cast("bigint").alias("i"),
        random_value({"type": "double", "min": 0, "max": 2.5}, 5, "d", k, algo="md5").alias("d"),
        random_value({"type": "bool", "true_chance": 35}, 5, "b", k, algo="md5").alias("b"),
        random_value({"type": "date", "min_year": 1932, "max_year": 2025}, 5, "t", k, algo="md5")
        .cast("string").alias("t"))


LONG_RANGES = {"a": (-2 ** 63, 2 ** 63 - 1), "b": (-2 ** 63, 0), "c": (-10, 2 ** 63 - 1), "d": (7, 7), "e": (-3, 10 ** 12)}


@add("g5_long_values", "select c_custkey n, " + ", ".join(
    f"(({low})::hugeint + (('0x' || substr(md5('5|{k}|' || c_custkey), 1, 16))::uhugeint % {high - low + 1}::uhugeint)"
    f"::hugeint)::bigint as {k}" for k, (low, high) in LONG_RANGES.items()) + " from customer")
def _g5l(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("n"), *[
        random_value({"type": "long", "min": low, "max": high}, 5, name, k, algo="md5").alias(name)
        for name, (low, high) in LONG_RANGES.items()])


def _ego(spark, sf, invert=False, share=30.0):
    return ego.generate(spark, _numbers(spark, sf, first=0), CLUB_GRAPH, share, invert)


@add("g7_ego_network")
def _g7(spark, sf):
    return _ego(spark, sf).edge_view(None, ()).select("label", "src", "dst")


@add("g7_ego_checks", "select 'Member' label, (select count(*) from customer) as egos, 0::bigint as orphans")
def _g7c(spark, sf):
    """One ego per customer; every alter and leaf hangs on exactly one tree edge."""
    g = _ego(spark, sf, share=0.0)
    egos = g.vertices["Member"].agg(F.count("*").alias("egos"))
    seen = g.edge_view(None, ()).groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("k"))
    rest = g.vertex_view(["Circle", "Medal"], ()).join(seen, F.col("id") == F.col("_d"), "left")
    orphans = rest.agg(F.sum((F.coalesce("k", F.lit(0)) != 1).cast("bigint")).alias("o")).select("o").scalar()
    return egos.select(F.lit("Member").alias("label"), "egos", orphans.alias("orphans"))


def _poisson_sql(u: str, rate: float = 1.0, terms: int = 40) -> str:
    """The inverse CDF, its sums written out."""
    chance, total, sums = math.exp(-rate), 0.0, []
    for k in range(1, terms):
        total += chance
        chance *= rate / k
        sums.append(f"({u} >= {total!r}::double)::int")
        if total >= 1 - 1e-15:
            break
    return " + ".join(sums)


@add("g8_degree_defaults", f"""select c_custkey n, cast(greatest(round_even(0.5 + {_hash_sql('u')}, 0), 0) as bigint) u,
 cast(greatest(round_even(exp(sqrt(-2 * ln(1 - {_hash_sql('l')})) * cos(2 * pi() * {_hash_sql('l/2')})), 0), 0) as bigint) l,
 cast({_poisson_sql(_hash_sql('p/part', "concat(c_custkey, '|1')"))} as bigint) p from customer""")
def _g8d(spark, sf):
    """Specs that leave all settings to the defaults."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("n"), gdeg.degree({}, 5, "u", k, algo="md5").alias("u"),
        gdeg.degree({"dist": "lognormal"}, 5, "l", k, algo="md5").alias("l"),
        gdeg.degree({"dist": "poisson"}, 5, "p", k, algo="md5").alias("p"))


@add("g8_degree_distributions", f"""select c_custkey n, cast(rint_u as bigint) u, 3::bigint f,
 cast(least(greatest(round_even(4 + sqrt(-2 * ln(1 - z1)) * cos(2 * pi() * z2) * 1.5, 0), 0), 9) as bigint) g
 from (select c_custkey, round_even(2 + {_hash_sql('u')} * 7, 0) rint_u, {_hash_sql('g')} z1, {_hash_sql('g/2')} z2
 from customer)""")
def _g8(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("n"), gdeg.degree({"dist": "uniform", "median": 5.5, "sigma": 3.5}, 5, "u", k, algo="md5").alias("u"),
        gdeg.degree({"dist": "fixed", "value": 3}, 5, "f", k).alias("f"),
        gdeg.degree({"dist": "normal", "mean": 4, "sigma": 1.5, "max": 9}, 5, "g", k, algo="md5").alias("g"))


@add("g9_shared_leaves", "select 0::bigint as strays, true as within")
def _g9(spark, sf):
    """Ego-leaf links: each must shadow an alter-leaf edge with equal properties; share near 30 %."""
    g = _ego(spark, sf)
    leaf = [t.df for t in g.edges if t.src_label == "Circle"][0]
    share = [t.df for t in g.edges if t.src_label == "Member" and "weight" in t.df.columns][0]
    j = leaf.select("dst", "weight").join(
        share.select(F.col("dst").alias("_d"), F.col("weight").alias("_v")), F.col("dst") == F.col("_d"), "full_outer")
    frac = F.count("_d").cast("double") / F.greatest(F.count("dst"), F.lit(1)).cast("double")
    return j.agg(F.sum((F.col("_d").isNotNull() & ~F.coalesce(F.col("weight") == F.col("_v"), F.lit(False)))
                       .cast("bigint")).alias("strays"), frac.between(0.2, 0.4).alias("within"))


@add("g10_inverted", "select 0::bigint as differing")
def _g10(spark, sf):
    """The inverted graph has every edge of the plain one with its ends swapped.

    All edges are different, so nothing is summed before they are dealt out by both ends; the stated number of tasks
    is left alone by the runtime, which would merge them by their compressed bytes, and ids are easy to compress.
    """
    a = _ego(spark, sf).edge_view(None, ()).select("src", "dst")
    b = _ego(spark, sf, invert=True).edge_view(None, ()).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = skew.spread(a.withColumn("w", F.lit(1)).unionByName(b.withColumn("w", F.lit(-1))), "src", "dst")
    d = both.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0")
    return d.agg(F.count("*").alias("differing"))


@add("g11_providers")
def _g11(spark, sf):
    from hopframe.generators.values import provided_columns
    specs = {"i": {"generator": "pyint(min_value=1, max_value=5)", "type": "int"},
             "f": {"generator": "pyfloat(min_value=-10, max_value=10)", "type": "double", "prefer_unique": True},
             "b": {"generator": "pybool(80)", "type": "bool"},
             "s": {"generator": "pystr(min_chars=3, max_chars=12)", "type": "string"},
             "d": {"generator": "date()", "type": "date"}, "c": {"generator": "company()", "type": "string"},
             "r": {"generator": "random_element(elements=['x', 'y'])", "type": "string"}}
    return table(spark, sf, "customer").select("c_custkey", *provided_columns(specs, 5, "p", F.col("c_custkey")))


@add("g12_value_checks", """select x."column", n checked, 0::bigint bad from nn cross join
 (select unnest(['i', 'f', 'b', 's', 'd', 'c', 'r']) "column") x""")
def _g12(spark, sf):
    kinds = {"i": "integer", "f": "double", "b": "boolean", "s": "string", "d": "date", "c": "string", "r": "string"}
    return check_values(_g11(spark, sf), kinds)


def _food(spark, sf):
    return food.generate(spark, _numbers(spark, sf), _numbers(spark, sf, "supplier", "s_suppkey"),
                         _numbers(spark, sf, "nation", "n_nationkey"))


@add("g13_food_dataset")
def _g13(spark, sf):
    return _food(spark, sf).edge_view(None, ()).select("label", "src", "dst")


@add("g13_food_checks", """select 'CustomerProfile' label, (select count(*) from customer) as rows, true as within union all
 select 'DeliveryAddress', (select count(*) from customer), true union all
 select 'Restaurant', (select count(*) from supplier), true union all
 select 'Driver', (select count(*) from nation), true""")
def _g13c(spark, sf):
    """Exact vertex counts; ``within`` also asks for 1-5 orders and 5-10 menu items each."""
    g = _food(spark, sf)
    base = (g.vertex_view(["CustomerProfile", "DeliveryAddress", "Restaurant", "Driver"], ()).groupBy("label")
            .agg(F.count("*").alias("rows")))
    per = g.edge_view(["PLACED"], ()).groupBy("src").agg(F.count("*").alias("k"))
    ok = per.agg(F.min(F.col("k").between(1, 5)).alias("ok")).select("ok").scalar()
    menu = (g.vertices["MenuItem"].groupBy(F.substring_index("menu_item_id", "_", 3)).agg(F.count("*").alias("k"))
            .agg(F.min(F.col("k").between(5, 10)).alias("ok")).select("ok").scalar())
    return base.select("label", "rows", (ok & menu).alias("within"))


def _sql_pick(stream: str, values: list[str], key: str = "o_orderkey") -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{items}], cast(floor({_hash_sql(stream, key)} * {len(values)}) as bigint) + 1)"


@add("g14_reviews", f"""select o_orderkey k, replace(replace({_sql_pick('rev/template', food.TEMPLATES)}, '{{aspect}}',
 {_sql_pick('rev/aspect', food.ASPECTS)}), '{{adj}}', case when {_hash_sql('rev/strong', 'o_orderkey')} < 0.5
 then concat({_sql_pick('rev/word', food.INTENSIFIERS)}, ' ', {_sql_pick('rev/adj', food.ADJECTIVES)})
 else {_sql_pick('rev/adj', food.ADJECTIVES)} end) review from orders""")
def _g14(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), food.review_text(5, "rev", F.col("o_orderkey"), algo="md5").alias("review"))


@add("g15_payments_dataset")
def _g15(spark, sf):
    return gen_payments.generate(spark, _numbers(spark, sf)).edge_view(["Transaction"], ["amount"]).select(
        "src", "dst", "amount")


@add("g15_payments_checks", """select n + 2 as users, n + 2 as accounts, true as transfers_within, 0::bigint as self_transfers
 from nn""")
def _g15c(spark, sf):
    g = gen_payments.generate(spark, _numbers(spark, sf))
    tx = g.edge_view(["Transaction"], ["amount"]).filter(F.col("eid").startswith("Transaction"))
    per = tx.groupBy("src").agg(F.count("*").alias("k"), F.min("amount").alias("lo"), F.max("amount").alias("hi"),
                                F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("self"))
    ok = per.agg(F.min(F.col("k").between(7, 14) & (F.col("lo") >= 1) & (F.col("hi") <= 1001)).alias("ok"),
                 F.sum("self").alias("self"))
    users = g.vertices["User"].agg(F.count("*").alias("u")).select("u").scalar()
    accounts = g.vertices["Account"].agg(F.count("*").alias("a")).select("a").scalar()
    return ok.select(users.alias("users"), accounts.alias("accounts"), F.col("ok").alias("transfers_within"),
                     F.col("self").alias("self_transfers"))


@add("g16_planted_hubs", """select concat('A', c_custkey) hub, true as targets_within, true as amounts_within from customer""")
def _g16(spark, sf):
    """A hub planted at every customer: 5-8 targets, 9-25 transfers each, 5 000-30 000."""
    n = _n(spark, sf)
    hubs = scale_free.numbered(spark, table(spark, sf, "customer").select(F.col("c_custkey").alias("n")))
    tx = gen_payments.hub_transfers(hubs, n)
    per = tx.groupBy("src", "dst").agg(F.count("*").alias("k"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    return per.groupBy(F.col("src").alias("hub")).agg(
        (F.count("*").between(5, 8) & F.min(F.col("k").between(9, 25))).alias("targets_within"),
        ((F.min("lo") >= 5000) & (F.max("hi") <= 30000)).alias("amounts_within"))


# ---- degree statistics -----------------------------------------------------------------------

def _hist(g):
    return degree.histogram(degree.degrees(g.vertices["Account"], g.edge_view(["Transaction"], ()), "both"))


_DEG = """(select a.id, (select count(*) from p_tx t where t.src = a.id) + (select count(*) from p_tx t
 where t.dst = a.id) d from p_account a)"""
on(payments_graph, "d1_degree_stats", lambda g: degree.stats(_hist(g)),
   f"""select count(*) as vertices, cast(sum(d) as bigint) edges, max(d) max_degree, min(d) min_degree,
 cast(sum(d) as double) / cast(count(*) as double) mean_degree, quantile_cont(d, 0.5)::double median_degree from {_DEG}""")
on(payments_graph, "d2_log_histogram", lambda g: degree.binned(_hist(g)),
   f"""select b0 bin_start, b1 bin_end, count(*) as vertices, cast(count(*) as double) * 100 /
 (select cast(count(*) as double) from p_account) percent from {_DEG} x join (select e b0, lead(e) over (order by e) b1,
 lead(e, 2) over (order by e) b2 from (select distinct round_even(pow(10, 1 + i * (log10(m) - 1) / 39), 0) e
 from (select max(d) m from {_DEG}), range(40) r(i))) b
 on d > 10 and d >= b0 and (d < b1 or (b2 is null and d = b1)) group by 1, 2""")
on(payments_graph, "d2_linear_histogram", lambda g: degree.binned(_hist(g), "linear"),
   f"""select b0 bin_start, b1 bin_end, count(*) as vertices, cast(count(*) as double) * 100 /
 (select cast(count(*) as double) from p_account) percent from {_DEG} x join (select e b0, lead(e) over (order by e) b1,
 lead(e, 2) over (order by e) b2 from (select distinct floor(lo + i * (hi + 1 - lo) / 19.0)::double e
 from (select max(d) hi, min(d) lo from {_DEG}), range(20) r(i))) b
 on d >= b0 and (d < b1 or (b2 is null and d = b1)) group by 1, 2""")


@add("d3_power_law_fit")
def _d3(spark, sf):
    degs = _g2(spark, sf)
    return degree.power_law_fit(degree.histogram(degs))


@add("d4_fit_verdict")
def _d4(spark, sf):
    return degree.fit_verdict(degree.histogram(_g2(spark, sf)))


# ---- telemetry ----------------------------------------------------------------------------------

def _buckets(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("ns"),
                                           F.concat(F.lit("s"), F.col("user_id") % 7).alias("service"), "value")
    return telemetry.to_buckets(ev, ["ns", "service"], "value", [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0])


def _quantile_sql(q: float) -> str:
    return f"""select ns, avg(v) as value from (select ns, service, min_by(case when le = 'Infinity'::double then ple
 else coalesce(ple, 0) + (le - coalesce(ple, 0)) * ({q} * tot - coalesce(pc, 0)) / (cnt - coalesce(pc, 0)) end, le) v
 from (select *, lag(le) over w ple, lag(cnt) over w pc, max(cnt) over (partition by ns, service) tot from buckets
 window w as (partition by ns, service order by le)) where cnt >= {q} * tot group by 1, 2) group by 1"""


for _q, _tag in ((0.95, "p95"), (0.99, "p99"), (0.999, "p999")):
    add(f"t1_latency_{_tag}", _quantile_sql(_q).replace("avg(v) as value", "round(avg(v), 6) as value"))(
        lambda spark, sf, q=_q: telemetry.average_quantile(_buckets(spark, sf), ["ns", "service"], "ns", q)
        .select("ns", F.round("value", 6).alias("value")))


@add("t2_heat_map", """select case when isinf(le) then '+Inf' else le::varchar end le, cast(sum(cnt) as bigint) "count"
 from buckets group by 1""")
def _t2(spark, sf):
    """Every bucket; the last bound is written as text, since it is infinite."""
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return telemetry.heat_map(_buckets(spark, sf)).select(bound.alias("le"), "count")


# ---- scalar functions -------------------------------------------------------------------------------

@add("c1_date_to_epoch", """select o_orderkey k, epoch_ms(date_trunc('day', o_orderdate)) ms,
 epoch_ms(date_trunc('day', o_orderdate)) // 1000 s from orders""")
def _c1(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.date_to_epoch_ms(day).alias("ms"),
                                             C.date_to_epoch_s(day).alias("s"))


@add("c2_epoch_to_datetime", "select event_id k, date_trunc('millisecond', ts) t from events")
def _c2(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"),
                                             C.epoch_ms_to_ts(C.ts_to_epoch_ms(F.col("ts"))).alias("t"))


@add("c3_padded_ids", "select concat('Order', lpad(o_orderkey::varchar, 19, '0')) id from orders")
def _c3(spark, sf):
    return table(spark, sf, "orders").select(C.padded_id("Order", F.col("o_orderkey")).alias("id"))


@add("c4_unwrap", "select o_orderkey k, case when o_orderkey % 2 = 0 then o_orderstatus end v from orders")
def _c4(spark, sf):
    lst = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus")).otherwise(
        F.array("o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.unwrap_single(lst).alias("v"))


@add("c5_iso_date", "select o_orderkey k, o_orderkey % 3 <> 0 ok from orders")
def _c5(spark, sf):
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-99")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.is_iso_date(day).alias("ok"))


@add("c6_or_unknown", """select o_orderkey k, case when o_orderkey % 4 = 0 then 'Unknown' else o_orderstatus end status
 from orders""")
def _c6(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        C.or_unknown(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus"))).alias("status"))


@add("c7_round2", "select o_orderkey k, round(o_totalprice / 7, 2) v from orders")
def _c7(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"),
                                             C.round2(F.col("o_totalprice") / 7).alias("v"))


# ---- streams -------------------------------------------------------------------------------------------

def _stream(spark, sf, name: str) -> DataFrame:
    """A table folder read as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _request_stream(spark, sf) -> DataFrame:
    n = _n(spark, sf)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    target = F.when(k % 3 == 0, F.pmod(k * 31 + 7, F.lit(n))).otherwise(F.pmod(k * 17 + 3, F.lit(n)))
    return _stream(spark, sf, "orders").select(
        F.concat(F.lit("R"), k).alias("payment"), F.concat(F.lit("P"), c).alias("person"),
        F.concat(F.lit("V"), c).alias("vpa"), F.concat(F.lit("V"), target).alias("target"),
        C.cents(F.col("o_totalprice")).alias("cents"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _finish(query) -> None:
    query.awaitTermination()


@add("x1_score_stream", """select r.payment, case when max(k.person) is not null then 'known'
 when count(t.eid) > 0 then 'second_degree' else 'first_time' end status from req r
 left join known k on k.person = r.person and k.receiver = r.target
 left join known k2 on k2.person = r.person left join e_tx t on t.src = k2.receiver and t.dst = r.target group by 1""")
def _x1(spark, sf):
    out = fresh_path(spark, "scored")
    _finish(jobs.score_beneficiaries(_request_stream(spark, sf), fraud_graph(spark, sf), out, f"{out}-ck"))
    return spark.read.schema("payment string, status string").parquet(f"{out}/batch=*")


@add("x2_velocity_stream", """select r.payment, r.vpa, r.cents, m.mean_amount,
 r.cents::double / 100::double / m.mean_amount ratio from req r left join (select src, cast(sum(cents) as double) /
 cast(count(*) as double) / cast(100 as double) mean_amount from e_tx group by 1) m on m.src = r.vpa""")
def _x2(spark, sf):
    out = fresh_path(spark, "velocity")
    scored = jobs.velocity_scores(_request_stream(spark, sf), fraud_graph(spark, sf))
    _finish(jobs.to_parquet(scored, out, f"{out}-ck"))
    return spark.read.schema(scored.schema).parquet(out)


@add("x2_hourly_stream", """select date_trunc('hour', ts) window_start, concat('V', user_id) vpa, count(*) payments,
 cast(sum(cast(round(value * 100) as bigint)) as bigint) total_cents from events group by 1, 2""")
def _x2h(spark, sf):
    """All windows, those still open at the end of the stream included."""
    out = fresh_path(spark, "hourly")
    ev = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("V"), F.col("user_id")).alias("vpa"),
        C.cents(F.col("value")).alias("cents"))
    _finish(jobs.upsert_windows(jobs.hourly_velocity(ev), out, f"{out}-ck"))
    return jobs.current_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("x3_assignment_stream", f"""select src, dst, 0::bigint assigned_date from f_delivered_by union all
 select order_id, driver_id, 1700000000 from {_ASSIGNED}""")
def _x3(spark, sf):
    out = fresh_path(spark, "assigned")
    k = F.col("o_orderkey")
    feed = _stream(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("order_"), k).alias("order_id"), F.concat(F.lit("driver_"), k % 60).alias("driver_id"),
        F.lit(1_700_000_000).cast("bigint").alias("assigned_date"))
    _finish(jobs.collect_assignments(feed, out, f"{out}-ck"))
    g = jobs.applied(food_graph(spark, sf), out)
    return _dated(g.edge_view(["DELIVERED_BY"], ["assigned_date"]))
