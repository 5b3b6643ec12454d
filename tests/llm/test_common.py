from cairn.llm import common

KEYS = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]


def test_batch_limits_only_go_down(spark):
    before = [spark.conf.get(k) for k in KEYS]
    try:
        for now, want in ((("10000", "64m"), ("256", str(16 << 20))), (("-1", "32m"), ("256", str(16 << 20))), (("100", "4096"), ("100", "4096"))):
            for k, v in zip(KEYS, now):
                spark.conf.set(k, v)
            common.small_batches(spark)
            assert tuple(spark.conf.get(k).rstrip("b") for k in KEYS) == want
    finally:
        for k, v in zip(KEYS, before):
            spark.conf.set(k, v)
