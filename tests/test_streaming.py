"""Deliveries as a stream."""

from __future__ import annotations

from pagemill.streaming.deliveries import delivery_store, item_sizes, upsert_deliveries

ENTRY = "row_id bigint, feed_id bigint, batch_id bigint, id string, link string"


def test_deliveries_of_a_stream(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    batches = [[(i, 1, b, f"u{i % 3}", "http://a.example/x") for i in range(b * 4, b * 4 + 6)] for b in range(3)]  # they overlap

    def deliver(n: int) -> None:
        spark.createDataFrame(batches[n], ENTRY).write.mode("append").parquet(str(source))

    def run(checkpoint: str) -> None:
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 2).parquet(str(source))
        query = upsert_deliveries(stream, store, str(tmp_path / checkpoint), blocks=2, every=2, availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None

    deliver(0)
    run("a")
    deliver(1)
    run("a")
    deliver(2)
    run("a")
    wanted = {("id", f"u{k}"): sum(i % 3 == k for i in range(14)) for k in range(3)} | {("link", "https://a.example/x"): 14}
    assert {(r["kind"], r["key"]): r["deliveries"] for r in item_sizes(spark, store).collect()} == wanted
    run("b")  # everything once more
    assert {(r["kind"], r["key"]): r["deliveries"] for r in item_sizes(spark, store).collect()} == wanted
    assert len(delivery_store(spark, store).runs()) == 1
