import shutil

from verdigris.sources.tables import path_exists
from verdigris.streaming.incremental import last_write_wins, read_upserted, stream_upsert

SCHEMA = "id long, v long, label string"


def test_batches_with_common_ids_merge_and_replays_change_nothing(spark, tmp_path):
    landing, target, offsets = (str(tmp_path / n) for n in ("landing", "target", "offsets"))
    run = lambda: stream_upsert(spark, landing, SCHEMA, "id", "v", target, offsets, buckets=3, files_per_batch=1).awaitTermination()
    read = lambda: sorted(tuple(r)[:3] for r in read_upserted(spark, target).select("id", "v", "label").collect())
    first = [(i, 1, "a") for i in range(20)]
    second = [(i, 2, "b") for i in range(10, 30)] + [(3, 0, "old")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    run()
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    run()
    want = [(i, 1, "a") for i in range(10)] + [(i, 2, "b") for i in range(10, 30)]
    assert read() == want
    # the last batch is lost from the log and runs again
    for f in ("commits/1", "commits/.1.crc"):
        (tmp_path / "offsets" / f).unlink(missing_ok=True)
    run()
    assert read() == want


def test_equal_versions_have_one_winner(spark):
    old, new = (spark.createDataFrame([(1, 5, x)], SCHEMA) for x in ("a", "b"))
    assert last_write_wins(old, new, "id", "v").collect() == last_write_wins(new, old, "id", "v").collect()


def test_path_exists(spark, tmp_path):
    assert not path_exists(spark, str(tmp_path / "none"))
    spark.range(1).write.parquet(str(tmp_path / "some"))
    assert path_exists(spark, str(tmp_path / "some"))
    shutil.rmtree(tmp_path / "some")
    assert not path_exists(spark, str(tmp_path / "some"))
