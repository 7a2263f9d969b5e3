"""A Spark session with the settings the reports are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Shuffles start wide and AQE folds small partitions together, so one setting serves small and
# large data; only the widest start grows with the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The heavy aggregates find few equal rows per task, so the small first-level map only costs:
    # without it the distinct sets ran about 30 % faster on 24 million rows, the rest as before.
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
}


def session(
    app: str = "custvalue",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """Get or create a session.

    ``shuffle_partitions`` should give tasks of about 128-256 MB: input bytes over that size on a
    cluster, the number of cores in tests. On a cluster also set ``spark.checkpoint.dir`` to a
    folder that every executor can reach. Dots in extra settings are written as ``__``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    extra = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
