"""The same operators on live data with Structured Streaming.

A finite table becomes a replayable stream of files in order of time; queries run with
``availableNow`` so a replay ends by itself. Sinks and state live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstream.functions.columns import ENTROPY_FRAGMENTS, col, numeric_columns, without_nan
from flowstream.operators.scoring import Scorer, window_scores
from flowstream.operators.thresholds import DspotStep
from flowstream.operators.windowing import _entropy_of
from flowstream.session import fresh_path
from flowstream.streaming.steps import filled_stream, steps_stream


def replay_files(df: DataFrame, ts: str, chunks: int = 4, close_after: str | None = None, path: str | None = None,
                 files_per_chunk: int = 1) -> str:
    """Write a table as files in order of time, one chunk of equal time span after the other.

    Files of one chunk are written side by side, so large chunks (``files_per_chunk`` > 1) go with a stream of as many
    ``max_files`` per trigger.

    ``close_after`` adds a last row that far behind the end, holding nothing but its time: it moves the
    watermark past every real row so that a finite replay emits its last windows. (Spark starts its watermark at 1970,
    so earlier times count as late.)
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "replay")
    df = df.withColumn(ts, col(ts).cast("timestamp"))
    lo, hi = df.agg(F.unix_micros(F.min(col(ts))), F.unix_micros(F.max(col(ts)))).first()
    width = (hi - lo) // chunks + 1
    for i in range(chunks):
        micros = F.unix_micros(col(ts))
        part = df.filter((micros >= lo + i * width) & (micros < lo + (i + 1) * width))
        part.repartitionByRange(files_per_chunk, col(ts)).sortWithinPartitions(col(ts)).write.mode("append").parquet(path)
    if close_after:
        end = df.agg((F.max(col(ts)) + F.expr(f"interval {close_after}")).alias(ts))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else col(ts) for f in df.schema.fields]
        end.select(*blank).write.mode("append").parquet(path)
    return path


def as_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, max_files: int = 1, fmt: str = "parquet") -> DataFrame:
    """Replayable stream over the files of a folder, oldest first. Reading it again restarts it."""
    schema = schema or spark.read.format(fmt).load(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def run_to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input into a parquet table and read it.

    With a ``path`` and a ``checkpoint`` folder of the caller's, a later call with the same stream goes on where this one
    ended: input already taken is not read again, state is kept, and the table grows.
    """
    spark = stream.sparkSession
    out = path or fresh_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint or f"{out}-state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_summary_stream(stream: DataFrame, ts: str = "Timestamp", freq: str = "1 second", label: str = "Label",
                          delay: str = "10 seconds", fill_gaps: bool = False) -> DataFrame:
    """The window summary on live data: two chained watermarked aggregations.

    The first counts the values of the identifiers and the label per (window, column, value), and sums all numbers in one more group of the window
    (whole numbers as whole numbers); the second turns them into entropies, sums and the label mode once the window is closed. A window straddling
    micro-batches comes out once. Rows later than ``delay`` are dropped by Spark and counted in the query's progress.
    With ``fill_gaps``, windows without rows come out (label BENIGN, everything else 0) as soon as a later window closes.
    """
    ids = [c for c in stream.columns if any(f in c for f in ENTROPY_FRAGMENTS)]
    nums = [c for c in numeric_columns(stream) if c not in ids and c not in (ts, label)]
    counted = [*ids, *([label] if label in stream.columns else [])]
    cells = F.array(*[F.struct(F.lit(i).alias("part"), col(c).cast("string").alias("value")) for i, c in enumerate(counted)],
                    F.struct(F.lit(len(counted)).alias("part"), F.lit(None).cast("string").alias("value")))
    numbers = F.struct(F.lit(0).alias("_none"), *[without_nan(stream, c).alias(f"n{i}") for i, c in enumerate(nums)])
    long = stream.withWatermark(ts, delay).select(col(ts).alias("_t"), numbers.alias("_n"), F.explode(cells).alias("_c")).select("_t", "_n", "_c.*")
    last = F.col("part") == len(counted)
    sums = [F.sum(F.when(last, F.col(f"_n.n{i}"))).alias(f"s{i}") for i in range(len(nums))]
    counts = long.groupBy(F.window("_t", freq).alias("_w"), "part", "value").agg(F.count(F.lit(1)).alias("c"), *sums)
    aggs = [_entropy_of(F.when((F.col("part") == i) & F.col("value").isNotNull(), F.col("c"))).alias(f"{c}_Entropy") for i, c in enumerate(ids)]
    aggs += [F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(c) for i, c in enumerate(nums)]
    if label in counted:
        mine = (F.col("part") == len(ids)) & F.col("value").isNotNull()
        rank = F.when(mine, F.struct((-F.col("c")).alias("c"), F.col("value").alias("v")))
        aggs.append(F.coalesce(F.min_by(F.when(mine, F.col("value")), rank), F.lit("BENIGN")).alias(label))
    out = counts.groupBy("_w").agg(*aggs)
    out = out.select(F.col("_w.start").alias(ts), *[col(c) for c in out.columns if c != "_w"])
    return filled_stream(out, ts, freq, label) if fill_gaps else out


def dspot_stream(stream: DataFrame, keys: Sequence[str] = ("stream_id",), ts: str = "ts", delay: str = "10 seconds", seq: str = "seq",
                 score: str = "score", **settings) -> DataFrame:
    """DSPOT on live scores. Rows wait until the watermark passes them, are put in order and then stepped,
    so the alerts do not depend on how the input falls into micro-batches. A null key is a stream."""
    out = steps_stream(stream, {"DSPOT": DspotStep(score=score, **settings)}, keys, ts, delay, seq, [ts, score], label="_step")
    return out.drop("_step")


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete epoch folders."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def score_stream(stream: DataFrame, features: Sequence[str], scorer: Scorer, label: str = "scores", keys: Sequence[str] = (), seq: str = "seq",
                 keep: Sequence[str] = (), path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """A window scorer on live data (each stream's rows in order of ``seq``), run over all available input.

    After each micro-batch the rows that later windows still learn from are carried on: per stream those of its last ``back``
    windows and of the open one, whatever has passed before. Scores and carried rows are written per epoch in overwrite mode, so a repeated epoch
    changes nothing. With a ``path`` and a ``checkpoint`` folder of the caller's, a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    root = path or fresh_path(spark, label)
    keys = list(keys)
    cols = list(dict.fromkeys([*keys, seq, *keep, *features]))
    kept = T.StructType([*stream.select(*cols).schema.fields, T.StructField("_w", T.LongType())])

    def handle(batch: DataFrame, epoch: int) -> None:
        new = batch.select(*cols).filter(col(seq).isNotNull()).withColumn("_w", F.expr(f"cast(`{seq}` div {scorer.window} as long)"))
        before = [e for e in _epochs(spark, f"{root}/carried") if e < epoch]
        near = new.withColumn("_new", F.lit(True))
        if before:
            old = spark.read.schema(kept).parquet(f"{root}/carried/epoch={before[-1]}")
            near = near.unionByName(old.withColumn("_new", F.lit(False)))
        scored = window_scores(near, features, scorer, keys, seq, [*keep, "_new"])
        scored.filter("_new").drop("_new").write.mode("overwrite").parquet(f"{root}/scores/epoch={epoch}")
        if keys:
            last = near.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_w").alias("_last"))
            needed = near.join(last, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        else:
            needed = near.withColumn("_last", F.lit(near.agg(F.max("_w")).first()[0]).cast("long"))
        needed.filter(F.col("_w") >= F.col("_last") - scorer.back).select(*cols, "_w").write.mode("overwrite").parquet(f"{root}/carried/epoch={epoch}")
        for e in before[:-1]:  # the one before is needed if this epoch is run again
            _delete(spark, f"{root}/carried/epoch={e}")

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint or f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    scores = T.StructType([*stream.select(*dict.fromkeys([*keys, seq, *keep])).schema.fields, T.StructField("score", T.DoubleType())])
    return spark.read.schema(scores).parquet(f"{root}/scores/epoch=*")
