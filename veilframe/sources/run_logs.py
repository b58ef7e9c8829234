"""Training logs from a tree ``run/checkpoint-N/trainer_state.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = (
    "best_model_checkpoint string, best_global_step long, log_history array<map<string,double>>"
)
STATE_PATH = "([^/]+)/checkpoint-([0-9]+)/[^/]+$"
# The same tree as Spark writes it: folders named by column and value.
WRITTEN_PATH = "run=([^/]+)/checkpoint=([0-9]+)/[^/]+$"


def write_run_logs(states: DataFrame, path: str) -> None:
    """One state file per ``run, checkpoint`` from its JSON ``value``."""
    states.write.partitionBy("run", "checkpoint").option("lineSep", "\n").text(path)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``run, checkpoint, best_checkpoint, best_step, pos, step, eval_f1, metrics``."""
    states = (
        spark.read.schema(STATE_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{trainer_state.json,part-*}")
        .json(path)
    )
    if not states.inputFiles():
        raise FileNotFoundError(f"no checkpoint under {path}")
    where = F.col("_metadata.file_path")
    rows = states.select(
        F.coalesce(*[F.nullif(F.regexp_extract(where, p, 1), F.lit("")) for p in (WRITTEN_PATH, STATE_PATH)]).alias("run"),
        F.coalesce(*[F.nullif(F.regexp_extract(where, p, 2), F.lit("")) for p in (WRITTEN_PATH, STATE_PATH)])
        .cast("int")
        .alias("checkpoint"),
        F.col("best_model_checkpoint").alias("best_checkpoint"),
        F.col("best_global_step").alias("best_step"),
        F.posexplode_outer("log_history").alias("pos", "metrics"),
    )
    return rows.withColumns(
        {
            "step": F.try_element_at("metrics", F.lit("step")).cast("long"),
            "eval_f1": F.try_element_at("metrics", F.lit("eval_f1")),
        }
    )
