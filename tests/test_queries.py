import pandas as pd

from quarry import queries

SMALL = "/root/testdata/sf0.001"


def test_whole_tables_against_brute_force(spark):
    run = lambda name: queries.queries()[name](spark, SMALL).toPandas()
    vectors = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    expected = sorted((i, float(x)) for i, v in zip(vectors.vec_id, vectors.embedding) if v is not None for x in v)
    assert sorted((i, float(x)) for i, x in run("unwind")[["vec_id", "embedding"]].itertuples(index=False)) == expected
    orders = pd.read_parquet(f"{SMALL}/orders.parquet")
    keys = orders.sort_values(["o_orderdate", "o_orderkey"]).groupby("o_custkey").o_orderkey.apply(list).to_dict()
    assert {r["_id"]: list(r["keys"]) for _, r in run("group_push").iterrows()} == keys
    told = orders.sort_values("o_orderkey").groupby("o_custkey").o_orderpriority.apply(list).to_dict()
    pulled = {c: [x for x in p if x != "5-LOW"] + ["9-NEW"] if c % 2 == 0 else p for c, p in told.items()}
    assert {r["c"]: list(r["p"]) for _, r in run("update_push_pull_add_to_set").iterrows()} == pulled
    assert {r["c"]: list(r["p"]) for _, r in run("update_push_slice").iterrows()} == {c: (p + ["a", "b"])[:3] for c, p in told.items()}
