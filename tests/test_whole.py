"""What the queries once left out."""

import hashlib

from conftest import SMALL

from ferrule.plans import catalog


def test_index_build_takes_every_segment(spark, tmp_path):
    data = [(1, "a", 0, "an old text", "text", "2025-01-01"), (2, "a", 0, "the new text", "text", "2025-02-01"), (3, "a", 1, "a scanned page", "page", "2025-01-01"), (4, "b", 0, "of no known type", None, "2025-01-01")]
    segments = spark.createDataFrame(data, "segment_id long, document_id string, seq int, text string, content_type string, day string")
    segments.withColumn("parsed_at", segments.day.cast("timestamp")).drop("day").write.parquet(str(tmp_path / "parsed_segments.parquet"))
    spark.read.parquet(f"{SMALL}/structured_chunks.parquet").limit(0).write.parquet(str(tmp_path / "structured_chunks.parquet"))
    got = catalog.index_build(spark, str(tmp_path)).collect()
    assert sorted((r.document_id, r.seq) for r in got) == [("a", 0), ("a", 100_000), ("b", 0)]
    key = hashlib.md5(b"a|0|0|3|the new text").hexdigest()
    assert key in {r.chunk_id for r in got}
