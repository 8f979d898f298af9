import os

import pytest
from conftest import pay_graph, rows
from pyspark.sql import functions as F

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.sources import checks, csv_graph, parquet_graph


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_headers():
    p = csv_graph.parse_header
    assert (p("~label:String").name, p("~label:String").dtype) == ("~label", "string")
    assert p("flag:Boolean").dtype == "boolean" and p("n:Long").dtype == "bigint" and p("x").dtype == "string"
    assert p("tags:string:list").dtype == "array<string>" and p("x", {"x": "int"}).dtype == "int"
    for bad in ("x:map", "x:list", "x:list:list", "x:string:set"):
        with pytest.raises(ValueError):
            p(bad)


def test_bulk_sample_with_reordered_edge_columns(spark, tmp_path):
    put(f"{tmp_path}/v/vertices.csv", "~id,~label,name:string\n" + "".join(
        f"i{k},interest,topic {k}\n" for k in range(9)) + "p1,person,Sam\n")
    put(f"{tmp_path}/e/edges.csv", "~label,~to,~from\n" + "".join(f"likes,i{k},p1\n" for k in range(5)))
    g, report = csv_graph.load(spark, f"{tmp_path}/v", f"{tmp_path}/e")
    assert {k: v.count() for k, v in g.vertices.items()} == {"interest": 9, "person": 1}
    assert rows(g.V("person").out("likes").ids(), "id") == [(f"i{k}",) for k in range(5)]
    assert rows(report, "stage", "label", "rows_in", "rows_ok", "rows_rejected") == [
        ("edges", "likes", 5, 5, 0), ("vertices", "interest", 9, 9, 0), ("vertices", "person", 1, 1, 0)]


def test_crlf_types_lists_and_rejects(spark, tmp_path):
    put(f"{tmp_path}/v/Thing/a.csv",
        '~id,age:int,ok:Bool,day:date,tags:string:list,phone\r\n'
        'a,7,TRUE,2024-02-29,"[\'x\', ""it\'s""]",9.20E+11\r\n'
        'b,,false,,"[""p"",""q""]",\r\n'
        'c,seven,TRUE,2024-01-01,[],1\r\n'
        'd,3,TRUE,2023-02-29,[],1\r\n'
        ',3,TRUE,2023-02-28,[],1\r\n')
    part = csv_graph.read_vertices(spark, f"{tmp_path}/v")[0]
    got = {r["~id"]: r for r in part.rows.collect()}
    assert sorted(got) == ["a", "b"] and part.rejected.count() == 3
    assert got["a"]["age"] == 7 and got["a"]["ok"] is True and str(got["a"]["day"]) == "2024-02-29"
    assert got["a"]["tags"] == ["x", "it's"] and got["a"]["phone"] == "9.20E+11" and got["a"]["~label"] == "Thing"
    assert got["b"]["age"] is None and got["b"]["tags"] == ["p", "q"] and got["b"]["phone"] is None


def test_field_counts_line_breaks_spaces_and_empty_texts(spark, tmp_path):
    put(f"{tmp_path}/v/N/a.csv", '~id,name,n:int\na,"line1\nline2",1\nb,x\nc,x,2,y\nd,"",3\ne,,4\nf,  padded  ,5\n')
    part = csv_graph.read_vertices(spark, f"{tmp_path}/v")[0]
    assert {r["~id"]: (r["name"], r["n"]) for r in part.rows.collect()} == {
        "a": ("line1\nline2", 1), "d": ("", 3), "e": (None, 4), "f": ("  padded  ", 5)}
    assert sorted(r["raw"] for r in part.rejected.collect()) == ["b,x", "c,x,2,y"]
    v = spark.createDataFrame([("a", "x\ny"), ("b", " p "), ("c", ""), ("d", None), ("e", 'q"')], "id string, name string")
    csv_graph.write_csv(PropertyGraph({"N": v}, ()), f"{tmp_path}/out")
    back = csv_graph.read_vertices(spark, f"{tmp_path}/out/vertices")[0]
    assert {r["~id"]: r["name"] for r in back.rows.collect()} == {r["id"]: r["name"] for r in v.collect()}


def test_ids_repeated_across_labels_are_found(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["1", "2"], ["2", "3", "3"]))
    e = spark.createDataFrame([("e", "1", "2")], "eid string, src string, dst string")
    found = checks.validate(PropertyGraph({"A": a, "B": b}, (EdgeTable("T", e, "A", "B"),)))
    assert rows(found, "label", "problems") == [("A", 1), ("B", 2), ("T", 0)]


def test_files_with_another_header_are_refused(spark, tmp_path):
    put(f"{tmp_path}/e/a.csv", "~from,~to,~label\n1,2,x\n")
    put(f"{tmp_path}/e/b.csv", "~label,~to,~from\nx,4,3\n")
    with pytest.raises(Exception):
        csv_graph.read_edges(spark, f"{tmp_path}/e")[0].rows.collect()


def test_missing_system_column(spark, tmp_path):
    put(f"{tmp_path}/e/a.csv", "~from,~label\n1,x\n")
    with pytest.raises(ValueError):
        csv_graph.read_edges(spark, f"{tmp_path}/e")


def test_duplicate_policies(spark):
    v = spark.createDataFrame([("a", None, 2), ("a", "x", 1), ("b", "y", 3)], "id string, p string, q int")
    assert rows(checks.duplicate_ids(v)) == [("a", 2)]
    with pytest.raises(checks.DuplicateVertexError):
        checks.resolve_duplicates(v, "fail")
    first = {r["id"]: (r["p"], r["q"]) for r in checks.resolve_duplicates(v, "first").collect()}
    assert first == {"a": (None, 2), "b": ("y", 3)}
    merged = {r["id"]: (r["p"], r["q"]) for r in checks.resolve_duplicates(v, "merge").collect()}
    assert merged == {"a": ("x", 1), "b": ("y", 3)}


def test_edge_ids_number_identical_rows(spark):
    e = spark.createDataFrame([("a", "b")] * 3 + [("a", "c")], "src string, dst string")
    out = csv_graph.with_edge_ids(e, "L")
    ids = [r["eid"] for r in out.collect()]
    assert len(set(ids)) == 4 and sorted(i.rsplit("#", 1)[1] for i in ids) == ["1", "1", "2", "3"]
    again = csv_graph.with_edge_ids(e.repartition(3), "L")
    assert sorted(ids) == sorted(r["eid"] for r in again.collect())


def test_dangling_edges(spark, transfers_graph):
    e = spark.createDataFrame([("1", "U1", "A1"), ("2", "U9", "A1"), ("3", "U1", "A9"), ("4", "U8", "A8")],
                              "eid string, src string, dst string")
    assert rows(checks.dangling_edges(transfers_graph, e), "eid") == [("2",), ("3",), ("4",)]
    assert {(r["label"], r["problems"]) for r in checks.validate(transfers_graph).collect()} == {
        ("User", 0), ("Account", 0), ("owns", 0), ("Transaction", 0)}


def test_csv_round_trip_with_rollover(spark, tmp_path):
    v = spark.createDataFrame([(f"n{i}", i, i / 3, i % 2 == 0, [f"a{i}", 'q"uote,'], f"x,{i}") for i in range(10)],
                              "id string, n bigint, d double, b boolean, tags array<string>, s string").coalesce(1)
    e = spark.createDataFrame([("e1", "n1", "n2", 5), ("e2", "n1", "n2", 5)], "eid string, src string, dst string, w int")
    g = PropertyGraph({"N": v}, (EdgeTable("TO", e, "N", "N"),))
    csv_graph.write_csv(g, str(tmp_path), max_rows=4)
    files = [f for f in os.listdir(f"{tmp_path}/vertices/N") if f.endswith(".csv")]
    assert len(files) == 3
    for f in files:
        with open(f"{tmp_path}/vertices/N/{f}") as fh:
            assert fh.readline().strip() == "~id,~label,n:long,d:double,b:bool,tags:string:list,s:string"
    back, _ = csv_graph.load(spark, f"{tmp_path}/vertices", f"{tmp_path}/edges")
    assert rows(back.vertices["N"], *v.columns) == rows(v)
    assert rows(back.edge_view(["TO"]), "src", "dst", "w") == [("n1", "n2", 5), ("n1", "n2", 5)]


def test_parquet_round_trip_and_adjacency(spark, transfers_graph, tmp_path):
    counts = parquet_graph.write_graph(transfers_graph, f"{tmp_path}/g")
    assert counts == {("vertex", "User"): 3, ("vertex", "Account"): 3, ("edge", "owns"): 3, ("edge", "Transaction"): 2}
    g = parquet_graph.read_graph(spark, f"{tmp_path}/g")
    assert rows(g.V("User").out("owns").out("Transaction").ids(), "seed", "id") == [("U1", "A2"), ("U3", "A1")]
    stored = parquet_graph.save_adjacency(g, "t_adj", f"{tmp_path}/adj", 4)
    assert rows(stored.V("User").out("owns").out("Transaction").ids(), "seed", "id") == [("U1", "A2"), ("U3", "A1")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.table("t_adj_transaction_0_by_src")
        # Both sides bucketed by src: no exchange at all.
        plan = e.join(e.select(F.col("src").alias("s2")).distinct(), F.col("src") == F.col("s2"))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hops_use_stored_adjacency_in_both_directions(spark, tmp_path):
    tx = [(f"t{i}", f"A{i % 17}", "A0" if i % 3 == 0 else f"A{i * 7 % 40}", i) for i in range(300)]
    g = PropertyGraph({"Account": spark.createDataFrame([(f"A{i}",) for i in range(40)], "id string")}, (EdgeTable(
        "pays", spark.createDataFrame(tx, "eid string, src string, dst string, w int"), "Account", "Account"),))
    stored = parquet_graph.save_adjacency(g, "t_both", f"{tmp_path}/adj", 4)
    for hop in (lambda f: f.out("pays"), lambda f: f.in_("pays"), lambda f: f.both("pays"),
                lambda f: f.out_e("pays").has("w", lambda w: w > 50).in_v(), lambda f: f.out("pays").in_("pays")):
        assert rows(hop(stored.V("Account")).ids()) == rows(hop(g.V("Account")).ids())
    hub = sum(d == "A0" for _, _, d, _ in tx)
    assert [df.count() for df in stored.edges[0].layout("dst")] == [len(tx) - hub, hub]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hop in (lambda f: f.out("pays"), lambda f: f.in_("pays")):
            # The buckets need an exchange of the frontier only; the hubs' join has two plain ones.
            plan = hop(stored.V("Account")).df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3
            bucketed = next(x for x in plan.split("SortMergeJoin") if "Bucketed: true" in x)
            assert bucketed.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ODD = ["x\ny", "\r", "a\r\nb", "\\", "\\n", "\\s\\\\n", "\u0001", "", None, ' "q", ', "é\n😀", "\n", "plain"]


@pytest.mark.parametrize("escaped", [False, True])
def test_texts_come_back(spark, tmp_path, escaped):
    v = spark.createDataFrame([(f"i{k}\n" if escaped else f"i{k}", t) for k, t in enumerate(ODD)], "id string, t string")
    e = spark.createDataFrame([("e", "i0", "i1", t) for t in ODD], "eid string, src string, dst string, t string")
    csv_graph.write_csv(PropertyGraph({"N": v}, (EdgeTable("TO", e),)), f"{tmp_path}/out", escaped=escaped)
    part = csv_graph.read_vertices(spark, f"{tmp_path}/out/vertices", multi_line=not escaped)[0]
    assert {r["~id"].rstrip("\n"): r["t"] for r in part.rows.collect()} == {f"i{k}": t for k, t in enumerate(ODD)}
    part = csv_graph.read_edges(spark, f"{tmp_path}/out/edges", multi_line=not escaped)[0]
    assert sorted(map(repr, (r["t"] for r in part.rows.collect()))) == sorted(map(repr, ODD))
    if escaped:
        # Whatever the caller says, such files are read line by line, so one file is split.
        csv_graph.write_csv(PropertyGraph({"N": v.coalesce(1)}, ()), f"{tmp_path}/one", escaped=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        try:
            assert csv_graph.read_vertices(spark, f"{tmp_path}/one/vertices")[0].parsed.rdd.getNumPartitions() > 1
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_writes_rejects_and_validates(spark, tmp_path):
    put(f"{tmp_path}/v/N/a.csv", "~id,~label,n:int\na,N,1\nb,,2\nb,M,3\n,N,4\nc,N,x\nd,N,1,2\n")
    put(f"{tmp_path}/e/TO/a.csv", "~from,~to\na,b\na,zz\n,a\n")
    put(f"{tmp_path}/e/NONE/a.csv", "~from,~to\n")
    g, report = csv_graph.load(spark, f"{tmp_path}/v", f"{tmp_path}/e", rejects=f"{tmp_path}/bad", validated=True)
    assert {k: rows(v) for k, v in g.vertices.items()} == {"N": [("a", 1), ("b", 2)], "M": [("b", 3)]}
    assert rows(g.edge_view(), "src", "dst") == [("a", "b"), ("a", "zz")]
    bad = spark.read.json(f"{tmp_path}/bad").collect()
    assert len(bad) == 4 and "d,N,1,2" in {r["raw"] for r in bad}
    assert rows(report) == [
        ("edge validation", "TO", 2, 1, 1), ("edges", "TO", 3, 2, 1), ("vertex validation", "M", 1, 0, 1),
        ("vertex validation", "N", 2, 1, 1), ("vertices", "M", 1, 1, 0), ("vertices", "N", 5, 2, 3)]


def test_infer_endpoints(spark, transfers_graph):
    g = PropertyGraph(transfers_graph.vertices, tuple(EdgeTable(t.label, t.df) for t in transfers_graph.edges))
    assert {(t.label, t.src_label, t.dst_label) for t in csv_graph.infer_endpoints(g).edges} == {
        ("owns", "User", "Account"), ("Transaction", "Account", "Account")}
