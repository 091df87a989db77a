import re
import time

from docloom.llm import linededup


def test_line_dedup_frees_what_earlier_steps_shuffled(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", manager.getAllBlocks().mkString(",")))
    before = shuffles()
    for _ in range(4):
        got = linededup.saved(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "step")
        time.sleep(0.5)
    end = time.time() + 5
    while len(shuffles() - before) > 1 and time.time() < end:
        time.sleep(0.1)
    assert len(shuffles() - before) <= 1  # the last one's may still be referred to
    assert got.count() == 7
