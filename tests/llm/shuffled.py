"""What a block of code sends through shuffles, with no join made a broadcast by its size."""

from contextlib import contextmanager


def _written(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


@contextmanager
def shuffled_bytes(spark):
    """A list that holds the number of bytes once the block is over."""
    before, sent = _written(spark), []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        sent.append(sum(n for k, n in _written(spark).items() if k not in before))
