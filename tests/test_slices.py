import pyarrow as pa

from revlens.functions import slices


def test_a_batch_of_long_texts_is_cut(spark):
    texts = pa.array(["x" * 100_000] * 10 + [None, "", "y" * 900_000, "z"])
    parts = slices.cuts((texts, pa.array(range(14))))
    assert [a for a, _ in parts] == [0, *[a + n for a, n in parts[:-1]]] and sum(n for _, n in parts) == 14
    assert max(n for _, n in parts[:3]) <= 3 and slices.cuts((pa.array([], pa.string()),)) == [(0, 0)]
    df = spark.range(40, numPartitions=1).selectExpr("id", "repeat(cast(id as string), 20000) t")
    size = slices.by_slices(lambda t: pa.array([len(t)] * len(t), pa.int32()), "int", "t")
    assert df.select(size.alias("n")).distinct().count() > 1  # before: one batch, all 40 rows
    told = df.select("id", size.alias("n"), slices.by_slices(lambda t: t, "string", "t").alias("same")).where("same <> t or n > 14").count()
    assert told == 0
