"""The pattern kept up to date on streams: forum state, distributors, and alerts for people who come to match."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import shared_folder


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if one:
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that is there now."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def new_distributors(sales: DataFrame) -> DataFrame:
    """(seller, first_buyer, second_buyer): a seller once, as soon as a second buyer is seen; its first one comes along.

    State is one buyer for each seller until then, and a mark afterwards.
    """

    def update(key, batches, state: GroupState):
        first, done = state.get if state.exists else (None, False)
        out = []
        for df in batches:
            for buyer in df["buyer"].tolist():
                if first is None:
                    first = buyer
                elif not done and buyer != first:
                    done = True
                    out.append((key[0], first, buyer))
        state.update((first, done))
        yield pd.DataFrame(out, columns=["seller", "first_buyer", "second_buyer"])

    return sales.groupBy("seller").applyInPandasWithState(update, "seller long, first_buyer long, second_buyer long", "first long, done boolean", "append", GroupStateTimeout.NoTimeout)


def item_masks(posts: DataFrame, topics: tuple) -> DataFrame:
    """(item, forum, mask, n, first) of a stream of (item, forum, topic, date): topic bits, rows and the first date."""
    bit = F.lit(0)
    for i, t in enumerate(topics):
        bit = F.when(F.col("topic") == t, 1 << i).otherwise(bit)
    return posts.groupBy("item", "forum").agg(F.bit_or(bit).alias("mask"), F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))


def kept_latest(stream: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Drain an update-mode aggregation; each batch's changed rows are kept as Parquet, and the last of each key count."""
    from pyspark.sql import Window

    spark = stream.sparkSession
    folder = shared_folder(spark, "state")

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/{batch:09d}")

    drained(stream, each, "update")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("recursiveFileLookup", True).parquet(folder)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n", "batch")


class Scoreboard:
    """Relevant records of a stream in Parquet, and the people already reported.

    Each micro-batch appends its own records under its number, so a batch that runs again overwrites itself. The answer
    is then asked for over what has been kept, and people who weren't reported before are alerts, with the time from the
    batch's arrival. The last answer equals the batch operator's over all records, in whatever order they came.
    """

    def __init__(self, spark: SparkSession, answer: Callable[[DataFrame], DataFrame]):
        self.spark, self.answer, self.folder = spark, answer, shared_folder(spark, "scoreboard")
        self.schema = None

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.folder}/records/{batch:09d}")
        arrived = F.current_timestamp()
        found = self.answer(self.records())
        new = found.join(self.alerts(batch), "person", "left_anti")
        new.select("person", F.lit(batch).alias("batch"), arrived.alias("at")).write.mode("overwrite").parquet(f"{self.folder}/alerts/{batch:09d}")

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/records")

    def alerts(self, before: int | None = None) -> DataFrame:
        """(person, batch, at) of all alerts, or those of earlier batches."""
        kind = "person long, batch int, at timestamp"
        if before == 0:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{self.folder}/alerts")
        return rows if before is None else rows.where(F.col("batch") < before)
