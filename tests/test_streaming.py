import pytest

from nodeloom.errors import CypherNotSupportedError
from nodeloom.streaming.queries import stream_query


def test_filter_over_a_stream(spark, tmp_path):
    spark.range(10).selectExpr("id AS _id", "id * 2 AS value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("_id long, value long").parquet(f"{tmp_path}/in")
    out = stream_query(stream, "Event", "MATCH (e:Event) WHERE e.value > $min WITH e.value AS v RETURN v, v + 1 AS w", {"min": 12})
    run = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("streamed").collect()) == [(14, 15), (16, 17), (18, 19)]
    with pytest.raises(CypherNotSupportedError):
        stream_query(stream, "Event", "MATCH (e:Event) RETURN count(e)")
