from lattica.streaming.blocks import grow_graph, latest_graph


def test_graph_grows_with_arriving_blocks(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    schema = "u long, v long, sum_bytes long, cnt long"
    for n, rows in enumerate(([(1, 2, 10, 1), (1, 3, 5, 1)], [(1, 2, 20, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        grow_graph(spark, src, out, ckpt).awaitTermination()
    assert sorted(map(tuple, latest_graph(spark, out, 1).collect())) == [(1, 2, 30, 3), (1, 3, 5, 1)]
