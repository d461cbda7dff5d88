"""Threshold alerts on every micro-batch; a fired rule is used up."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.operators.live_metrics import alert_messages, evaluate_rules, section_metrics
from crowdtide.sources.live import latest_per_location
from crowdtide.sources.rules import delete_rules, upsert_rules

RULE = "id BIGINT, facility_id BIGINT, section_key STRING, threshold INT, endpoint STRING, created_at TIMESTAMP"
CHANGE = f"{RULE}, change STRING, change_id STRING"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A finished table, or None; an unfinished one counts as none."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.schema(schema).parquet(path)


def new_changes(spark: SparkSession, changes_path: str, seen_path: str, batch_id: int) -> DataFrame:
    """Rule changes from outside that no earlier batch took; the choice is written, so a repeated batch takes the same.

    Changes are appended at any time by anyone, each with a ``change_id`` of its own, and are not
    altered afterwards.
    """
    mine = f"{seen_path}/batch={batch_id}"
    done = _written(spark, mine, CHANGE)
    if done is None:
        try:
            waiting = spark.read.schema(CHANGE).parquet(changes_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            waiting = spark.createDataFrame([], CHANGE)
        earlier = [f"{seen_path}/batch={k}" for k in range(batch_id)]
        if earlier:
            waiting = waiting.join(spark.read.schema(CHANGE).parquet(*earlier).select("change_id"), "change_id", "left_anti").select(*waiting.columns)
        waiting.write.mode("overwrite").parquet(mine)
        done = spark.read.schema(CHANGE).parquet(mine)
    return done


def merge_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after a batch of changes: per endpoint the last written rule counts, then deleted ids go."""
    fresh = changes.filter("change = 'upsert'").select(*rules.columns)
    return delete_rules(upsert_rules(rules, fresh), changes.filter("change = 'delete'"))


def alert_batch(rules_path: str, outbox: str, live_path: str, sections: DataFrame, capacity: DataFrame, names: DataFrame, changes_path: str | None = None):
    """foreachBatch writer: latest readings -> section percents -> outbox, minus fired rules.

    Rules and latest readings are kept as one folder per batch, so a batch that is run
    again after a failure starts from the same input and replaces its own output.  Rules that
    others add, replace or delete meanwhile come as rows under ``changes_path`` and are merged into the
    batch's rules before they are evaluated.
    """

    def read_last(spark, root: str, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{root}/batch={batch_id - 1}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["id", "is_closed", "current_capacity", "observed_at"]
        newest = latest_per_location(batch, columns)
        if batch_id > 0:
            known = read_last(spark, live_path, batch_id)
            newest = latest_per_location(known.unionByName(newest), columns)
        newest.write.mode("overwrite").parquet(f"{live_path}/batch={batch_id}")
        live = spark.read.parquet(f"{live_path}/batch={batch_id}")
        rules = read_last(spark, rules_path, batch_id)
        if changes_path is not None:
            rules = merge_changes(rules, new_changes(spark, changes_path, f"{rules_path}-changes", batch_id))
        fired = alert_messages(evaluate_rules(rules, section_metrics(live, sections, capacity)), names)
        fired.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
        sent = spark.read.parquet(f"{outbox}/batch={batch_id}")
        delete_rules(rules, sent).write.mode("overwrite").parquet(f"{rules_path}/batch={batch_id}")

    return write
