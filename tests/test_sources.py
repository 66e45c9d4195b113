import pandas as pd

from meshwork.operators import contract as C
from meshwork.operators import graph as G
from meshwork.sources import products as S


def test_csv_product_null_tokens_and_numbers(spark, tmp_path):
    p = tmp_path / "telco_churn.csv"
    p.write_text("customerID,TotalCharges,Churn\nA1,10.5,Yes\nA2,NA,No\nA3,,N/A\n")
    df = S.read_product_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types["TotalCharges"] == "double"
    rows = sorted(df.collect())
    assert rows[1].TotalCharges is None and rows[2].Churn is None
    assert S.product_name(str(p)) == "telco_churn"


def test_discover_and_write(spark, tmp_path):
    for n in ("a_one", "b"):
        (tmp_path / f"{n}.csv").write_text("x,y\n1,2\n")
    (tmp_path / "skip.txt").write_text("no")
    found = S.discover_products(spark, str(tmp_path))
    assert sorted(found) == ["a_one", "b"]
    out = S.write_product(found["b"], str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(out).count() == 1


def test_graph_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "One year", "Yes"), ("c2", "", "No"), ("c1", "Two year", None)],
                               "customerID string, Contract string, Churn string")
    g = G.build_graph(df, G.TELCO_GRAPH)
    assert g.edges.count() == 4  # one per row and present value, duplicates not multiplied
    G.write_graph(g, str(tmp_path / "g"))
    back = G.read_graph(spark, str(tmp_path / "g"), g.entities, G.TELCO_GRAPH)
    assert back.nodes.count() == g.nodes.count()
    cur = G.graph_is_current(back.nodes, 3, "Customer", ["Customer", "Contract", "ChurnStatus"])
    assert cur.first().is_current


def test_csv_like_pandas(spark, tmp_path):
    p = tmp_path / "feedback.csv"
    p.write_text('id,feedback,score,code\n1,"He said ""no"", then left",1.5,1d\n2,"two\nlines",NA,2\n'
                 '3,plain,n/a,3\n4,"a,b",-2e3,NULL\n', newline="")
    want = pd.read_csv(p)
    df = S.read_product_csv(spark, str(p))
    got = df.orderBy("id").toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.feedback.tolist() == want.feedback.tolist()
    assert dict(df.dtypes)["score"] == "double" and dict(df.dtypes)["code"] == "string"
    assert [None if pd.isna(x) else x for x in got.score] == [None if pd.isna(x) else x for x in want.score]
    assert [None if pd.isna(x) else x for x in got.code] == [None if pd.isna(x) else x for x in want.code]


def test_discover_folders_with_and_without_scheme(spark, tmp_path):
    spark.range(3).repartition(2).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "two.parquet"))
    (tmp_path / "_hidden.parquet").mkdir()
    for folder in (str(tmp_path), tmp_path.as_uri()):
        found = S.discover_products(spark, folder, "parquet")
        assert {k: v.count() for k, v in found.items()} == {"one": 3, "two": 5}


def test_publish_profiles_and_validates(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", 3)], "k string, v int")
    contract = spark.createDataFrame(
        [("p", "k", "string", False, True, ["a"], ""), ("p", "v", "int", False, False, None, ""),
         ("p", "gone", "int", True, False, None, "")], C.COLUMN_SCHEMA)
    reg = S.publish_product({}, "p", df, contract)
    checks = sorted((r.column_name, r.check) for r in reg["p"]["violations"].collect())
    assert checks == [("gone", "missing"), ("k", "allowed"), ("k", "unique"), ("v", "nullable")]
    assert {r.column_name: r.null_count for r in reg["p"]["profile"].collect()} == {"k": 0, "v": 1}
    reg = S.publish_product(reg, "q", df)
    assert reg["q"]["violations"].count() == 0 and reg["q"]["contract"].count() == 2
    assert spark.table("q").count() == 3


def test_graph_port(spark, tmp_path):
    df = spark.createDataFrame([("c1", "One year", "Yes")], "customerID string, Contract string, Churn string")
    path = S.write_product(df, str(tmp_path / "g"), "graph", spec=G.TELCO_GRAPH)
    assert spark.read.parquet(f"{path}/edges").count() == 2
