"""Runtime settings: what may be sent around as a whole."""
from pyspark.sql import functions as F

from showerframe.session import HASHED, HASHED_BYTES, MEASURED, PLANNED, tune


def test_a_small_file_of_many_rows_is_not_sent_around(spark, ws):
    """The planner takes the bytes of a file for those of its rows, however well they are compressed and however often each
    is repeated before the join."""
    before = {key: spark.conf.get(key, None) for key in (PLANNED, MEASURED)}
    try:
        spark.conf.set(PLANNED, "10MB"), spark.conf.unset(MEASURED)
        tune(spark)
        rows = ws.save(spark.range(300_000).select("id", F.lit(1.0).alias("E")), "rows")
        around = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(27)])))
        met = rows.join(around.groupBy("id", "k").agg(F.sum("E").alias("sum")), "id")
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == 27 * 300_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_smaller_limits_of_the_session_stay(spark):
    before = {key: spark.conf.get(key, None) for key in (PLANNED, MEASURED)}
    try:
        for planned, measured, expected in (("-1", None, (-1, -1)), ("16k", "1m", (16 << 10, 1 << 20)), ("-1", "2m", (-1, 2 << 20))):
            spark.conf.set(PLANNED, planned)
            spark.conf.unset(MEASURED) if measured is None else spark.conf.set(MEASURED, measured)
            tune(tune(spark))
            assert (int(spark.conf.get(PLANNED)), int(spark.conf.get(MEASURED))) == expected
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_small_parts_are_joined_by_hash(spark, ws):
    """neither side is sorted where the parts of one are small; a limit of the session's own stays."""
    before = {key: spark.conf.get(key, None) for key in (HASHED, PLANNED, MEASURED)}
    try:
        spark.conf.unset(HASHED), spark.conf.set(PLANNED, "-1"), spark.conf.set(MEASURED, "-1")
        tune(spark)
        assert int(spark.conf.get(HASHED)) == HASHED_BYTES
        rows = ws.save(spark.range(20_000), "rows")
        met = rows.join(rows.select((F.col("id") * 2).alias("id"), F.lit(1).alias("one")), "id")
        assert met.count() == 10_000 and len(met.collect()) == 10_000
        assert "ShuffledHashJoin" in met._jdf.queryExecution().executedPlan().toString()
        spark.conf.set(HASHED, "1m")
        tune(spark)
        assert spark.conf.get(HASHED) == "1m"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffle_files_go_with_the_job(spark, ws):
    """what a job shuffled leaves the disk once its table is written, and not when the driver happens to collect garbage."""
    import glob
    import time

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    rows = spark.range(50_000).select((F.col("id") % 20_000).alias("k")).groupBy("k").count()
    before = shuffled()
    held = rows.collect()  # a plan that may be run again keeps its files
    assert len(held) == 20_000 and shuffled() - before
    before = shuffled()
    for save in (lambda: ws.save(rows.filter("k > 1"), "rows"), lambda: ws.save_by(rows.filter("k > 1"), "rows", "k", 2)[0]):
        saved = save()
        for _ in range(20):
            if not shuffled() - before:
                break
            time.sleep(0.1)
        assert not [f for f in shuffled() - before if f.endswith(".data")]
        assert saved.count() == 19_998
        before = shuffled()
