"""Streams give what the batch gives."""

import shutil

from quire.plans import catalog
from quire.streaming import events as S

SF = "/root/testdata/sf0.001"


def run(stream, name, mode, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    live = S.source(spark, str(tmp_path), batch.schema)
    got = {(r.user_id, r.event_id, r.event_type) for r in run(S.latest_status(live), "latest", "complete", spark).collect()}
    assert got == {(r.user_id, r.event_id, r.event_type) for r in catalog.QUERIES["status_latest"](spark, SF).collect()}
    counts = run(S.windowed_counts(live), "counts", "complete", spark)
    assert sum(r.n for r in counts.collect()) == batch.count()
