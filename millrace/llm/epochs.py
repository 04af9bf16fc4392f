"""Problem 4: a reproducible sample that keeps its members as data grows, by epoch-rate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import shared_dir

_BITS = 52


def draw(seed: int, identifier: Column, counter: int = 0) -> Column:
    """A number in [0, 1) from a counter-based generator: block ``counter`` of the stream keyed by ``seed`` and the identifier.

    It needs no state and no order, so it is the same on every run, machine and partitioning.
    """
    block = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.lit(str(counter)), identifier), 256)
    return F.conv(F.substring(block, 1, _BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def first_seen(records: DataFrame) -> DataFrame:
    """``id, epoch``: the first epoch of each id. ``records`` has ``id`` and ``epoch``; null epochs come last, as null.

    Combined before the shuffle, so an id with a third of all rows costs one row a task.
    """
    return records.where("id is not null").groupBy("id").agg(F.min("epoch").alias("epoch"))


def register(state: DataFrame | None, arrivals: DataFrame, rate: Column | float) -> DataFrame:
    """The state after ``arrivals``: known ids keep their epoch and frozen rate, new ones get theirs now.

    ``state`` has ``id, epoch, rate``, ``arrivals`` has ``id, epoch``. Later arrivals with an earlier epoch
    change nothing for a known id. Null ids are left out; a null rate selects nothing. Without a state all are new.
    """
    return _new(state, arrivals, rate) if state is None else state.select("id", "epoch", "rate").unionByName(_new(state, arrivals, rate))


def _new(state: DataFrame | None, arrivals: DataFrame, rate: Column | float) -> DataFrame:
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    seen = first_seen(arrivals)
    return (seen if state is None else seen.join(state.select("id"), "id", "left_anti")).withColumn("rate", rate.cast("double"))


def register_kept(arrivals: DataFrame, rate: Column | float, name: str) -> DataFrame:
    """The state ``name`` in the shared folder after ``arrivals``, which are one batch: new ids are appended to it.

    It is a Parquet table ``id, epoch, rate`` that grows with each call and is not deleted with the stages, so it is
    kept as long as the folder in ``spark.checkpoint.dir``. One call at a time may write a state.
    """
    spark = arrivals.sparkSession
    path = f"{shared_dir(spark)}/state-{name}"
    schema = f"id {arrivals.schema['id'].dataType.simpleString()}, epoch {arrivals.schema['epoch'].dataType.simpleString()}, rate double"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    state = spark.read.schema(schema).parquet(path) if known else spark.createDataFrame([], schema)
    _new(state, arrivals, rate).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def select(state: DataFrame, seed: int = 7) -> DataFrame:
    """``id, epoch, rate, draw, selected``: an id is selected if its draw lies below its frozen rate.

    Neither the draw nor the rate of a known id ever changes, so a selected id stays selected. Ids are
    compared as strings. Empty state gives an empty result.
    """
    drawn = state.withColumn("draw", draw(seed, F.col("id").cast("string")))
    return drawn.withColumn("selected", F.coalesce(F.col("draw") < F.col("rate"), F.lit(False)))


def broken_nesting(observations: DataFrame) -> DataFrame:
    """``id, lowest_in, highest_out`` of ids that no fixed draw can explain.

    ``observations`` has ``id``, ``rate`` and ``selected``: at a rate the id was in or out of a sample. The
    observations are replayed as epochs, one for each rate, in ascending order: an id is registered at the
    first rate at which it was in, which is its epoch and its frozen rate. Its draw lies below that rate, so it
    must be in at each higher one; one that was out at a higher rate breaks the rule. Null ids and flags and
    null, negative and NaN rates don't count; repeated rows count once; being in and out at the same rate is
    not a break.
    """
    good = observations.where("id is not null and selected is not null and rate >= 0 and not isnan(rate)")
    state = register(None, good.where("selected").select("id", F.col("rate").alias("epoch")), F.col("epoch"))
    out = good.where("not selected").groupBy("id").agg(F.max("rate").alias("highest_out"))
    return state.join(out, "id").where("rate < highest_out").select("id", F.col("rate").alias("lowest_in"), "highest_out")
