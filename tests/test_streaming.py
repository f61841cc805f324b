from __future__ import annotations

from clickscore.plans import context as C
from clickscore.sources import fixtures as FX
from clickscore.streaming import stream_base_events, stream_events
from tests.conftest import SF01


def test_stream_base_equals_batch(spark, tmp_path):
    ev = stream_events(spark, SF01)
    out = stream_base_events(ev, FX.survey_responses(spark, SF01), FX.dim_features(spark), FX.APP, FX.ROLE)
    q = (out.writeStream.format("memory").queryName("stream_base90").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("stream_base90")
    batch = C.base90_lazy(spark, SF01)
    assert got.count() == batch.count() == 4454
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
