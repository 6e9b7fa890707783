import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture
def shuffled(spark):
    """Bytes that a function's stages write for shuffles."""

    def run(act):
        context = spark.sparkContext
        store, empty = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList

        def total():
            context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), empty())
            return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

        before = total()
        act()
        return sum(n for stage, n in total().items() if stage not in before)

    return run
