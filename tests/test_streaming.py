import threading

from litspark.streaming.events import event_windows, route_arrivals, run_to_end


def test_windows_of_stream_and_batch_agree(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted((r["hour"], r["event_type"], r["events"]) for r in df.collect())
    assert rows(run_to_end(event_windows(stream))) == rows(event_windows(events))


def test_arrivals_are_routed(spark, tmp_path):
    papers = spark.createDataFrame([("a", "seismic", ""), ("a", "seismic", ""), ("b", "none", "")], "arxiv_id string, title string, abstract string")
    papers.write.parquet(str(tmp_path / "in"))
    got, lock = [], threading.Lock()

    def sink(batch, number):
        with lock:
            got.extend((number, r["arxiv_id"], r["cell"]) for r in batch.collect())

    stream = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "in"))
    route_arrivals(stream, sink, str(tmp_path / "state")).awaitTermination()
    assert got == [(0, "a", "geology")]
