"""Result writers: tables, metric rows, anomalous rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from oddlog.functions.rows import quoted

# One superset of fields, so rows of any kind share one header.
METRICS_SCHEMA = T.StructType([
    T.StructField(name, kind)
    for kind, names in (
        (T.StringType(), ("name", "strategy")),
        (T.LongType(), ("n_samples", "n_anomalies")),
        (T.StringType(), ("best_params",)),
        (T.DoubleType(), ("best_score",)),
        (T.StringType(), ("cv_results",)),
        (T.DoubleType(), ("accuracy", "precision", "recall", "f1_score")),
        (T.LongType(), tuple(f"confusion_matrix_{part}" for part in (
            "true_negatives", "false_positives", "false_negatives", "true_positives"))),
        (T.DoubleType(), ("score_mean", "score_min", "score_max")),
        (T.StringType(), ("sequence_config",)),
        (T.LongType(), ("n_sequences", "n_seq_anomalies", "n_rows", "n_row_anomalies", "n_models")),
    )
    for name in names
])


_CSV = {
    "sep": ";", "header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _flat_cells(df: DataFrame) -> DataFrame:
    """List and map cells as JSON text, since CSV has no nested values."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        (F.to_json(quoted(f.name)) if isinstance(f.dataType, nested) else quoted(f.name)).alias(f.name)
        for f in df.schema.fields
    ])


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``;``-separated files with a header, written by the executors."""
    _flat_cells(df).write.mode(mode).options(**_CSV).csv(path)
    return path


def metrics_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Metric rows, nested fields joined with ``_``, absent ones null."""
    names = METRICS_SCHEMA.fieldNames()

    def flat(row: dict, prefix: str = "") -> dict:
        out = {}
        for key, value in row.items():
            out.update(flat(value, f"{prefix}{key}_") if isinstance(value, dict) else {prefix + key: value})
        return out

    ready = []
    for row in map(flat, rows):
        unknown = set(row) - set(names)
        if unknown:
            raise ValueError(f"unknown metric fields {sorted(unknown)}")
        ready.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(ready, METRICS_SCHEMA)


def append_metrics(spark: SparkSession, rows: list[dict], path: str) -> str:
    return write_table(metrics_frame(spark, rows), path, "append")


def write_anomalies(rows: DataFrame, flagged: DataFrame, path: str, key: str = "row_id") -> str:
    """Rows named in ``flagged`` (key, strategy, task), one folder per task.

    Task names can be longer than a folder name may be, so the folder goes by
    a digest and the name is a column.
    """
    hits = rows.join(flagged.select(key, "strategy", "task").distinct(), key).drop(key)
    hits = _flat_cells(hits).withColumn("task_key", F.md5("task"))
    hits.write.mode("append").partitionBy("strategy", "task_key").options(**_CSV).csv(path)
    return path


def reset(spark: SparkSession, *paths: str | None) -> None:
    """Drop what an earlier run left under these result paths."""
    for path in filter(None, paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
