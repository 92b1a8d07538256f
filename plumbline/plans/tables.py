"""Tables of the demonstration data in the shapes the operators expect.

Every view is a projection (or key join) of the given parquet tables, so its
size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Clinical visits from ``events``: subject, time, vital signs, dates; gaps where the type says so."""
    e = table(spark, folder, "events")
    k = F.expr("CAST(substring(props, 7, length(props) - 7) AS INT)")  # props is {"k": number}
    day = F.col("ts").cast("date")
    return e.select(
        "event_id", F.col("user_id").alias("subject_id"), F.col("ts").alias("visit_time"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("heart_rate"),
        (F.lit(40.0) + k * 2.0).alias("systolic_bp"), F.col("value").alias("diastolic_bp"),
        F.when(F.col("event_type") != "signup", F.lit(50.0) + k).alias("weight"),
        (F.lit(36.0) + F.floor(k / F.lit(34.0)) * 0.5).alias("temperature"),
        (k * 2 - 20).alias("age"), (k + F.lit(10.0)).alias("body_temp"),
        day.cast("string").alias("start_date"),
        F.when(F.col("event_type") != "signup", F.date_add(day, k - 20).cast("string")).alias("end_date"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("site"))


VISIT_RULES = {"heart_rate": "heart_rate", "systolic_bp": "systolic_bp", "diastolic_bp": "diastolic_bp",
               "weight": "weight", "temperature": "temperature", "body_temp": "temperature"}


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """A long table of named parameters from ``events``, with names as sites spell them."""
    name = (F.when(F.col("event_type") == "view", "Heart Rate").when(F.col("event_type") == "click", "SBP")
            .when(F.col("event_type") == "purchase", "Weight_kg").when(F.col("event_type") == "signup", "Body Temperature")
            .otherwise("zzq"))
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("subject_id"), name.alias("parameter"), "value")


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset records from ``customer``: owner is the nation."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("name"),
        F.concat(F.col("c_mktsegment"), F.lit(".csv")).alias("original_filename"),
        F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("is_archived"),
        F.col("c_custkey").alias("created_at"))


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis records from ``orders``: dataset is the customer, owner the customer's nation."""
    owner = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("user_id"))
    status = (F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PROCESSING")
              .otherwise("FAILED"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("dataset_id"), status.alias("status"),
        (F.col("o_totalprice") / 5000.0).alias("quality_score"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_totalprice").cast("decimal(18,6)"))).alias("completed_at")
    ).join(owner, "dataset_id", "left")


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") != 0).alias("is_active"), F.col("n_nationkey").alias("created_at"))


def stored_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Stored findings from ``lineitem``: analysis is the order."""
    score = F.round(F.col("l_discount") * 10, 4)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_key"),
        F.concat(F.lit("col_"), F.col("l_linenumber").cast("string"), F.lit("_"),
                 F.col("l_quantity").cast("int").cast("string")).alias("column_name"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"),
        score.alias("anomaly_score"),
        F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")
        .alias("severity"),
        F.when(F.col("l_linestatus") == "F", "statistical")
        .when(F.col("l_tax") >= 0.04, "statistical, clinical_rules").otherwise("missing_data").alias("detection_method"),
        (F.col("l_returnflag") == "R").alias("is_reviewed"),
        F.when(F.col("l_returnflag") == "R", "seen").alias("review_note"),
        (F.col("l_returnflag") == "A").alias("is_false_positive"), F.col("l_shipdate").alias("created_at"))
