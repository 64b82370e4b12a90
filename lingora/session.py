"""One place for the session settings that the engine relies on."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lingora", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the same settings that a cluster session should carry."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the test data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_leaf(df: DataFrame) -> DataFrame:
    """The rows of a checkpointed df, without the estimates and constraints of the plan that made them.

    A checkpoint keeps these, and a join multiplies estimates: in loops over checkpoints the digits of the estimated size
    double with every join, until the numbers alone fill the driver. Row by row, so nothing is computed or sent here.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def durable(df: DataFrame) -> DataFrame:
    """df computed now and kept in the folder of spark.checkpoint.dir, which all machines of a cluster have to share.

    A local session that names no folder gets a temporary one.
    """
    spark = df.sparkSession
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lingora-checkpoint-"))
    return as_leaf(df.checkpoint(eager=True))
