"""The registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import removed, shuffles_removed, with_row_index
from ..functions.schema import quoted
from ..operators import (by_table, duplicates, ensemble, explain, hits, iforest, lof, longitudinal, mapping, missing, profile,
                         quality, reconstruct, results, rules, sketches, univariate)
from ..operators.vocabulary import CLINICAL_RANGES
from ..sources import csv as csv_source
from ..sources import files, ingest, reviews, sinks
from ..streaming import score
from .analysis import AnalysisConfig, Detector, analyze, stored_analysis
from .tables import (VISIT_RULES, analyses, datasets, readings, stored_findings, table, users, visits)

Query = Callable[[SparkSession, str], DataFrame]
SHAPE = ["row_key", "column_name", "method", "score", "z_score", "expected_min", "expected_max"]
NOTED = ["row_key", "column_name", "method", "score", "anomaly_type", "note"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
OWNER = 7
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shape(h: DataFrame) -> DataFrame:
    return h.select(*SHAPE)


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    from ..functions.chunks import checkpoint_folder
    return f"{checkpoint_folder(spark)}/plumbline-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once to a folder of its own and read from there, for queries that use it several times."""
    path = path or scratch(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


# ---- sources and sinks -------------------------------------------------------------------------

@query
def csv_round_trip(spark, folder):
    """Orders written as semicolon-separated text, sniffed, typed and read back."""
    path = scratch(spark)
    o = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    o.write.option("header", True).option("sep", ";").csv(path)
    return csv_source.read_csv(spark, path)


def _folder_of_files(spark, folder) -> str:
    """CSV files that differ in delimiter, columns and gaps, one of them a copy of another, one with bad lines."""
    path = scratch(spark)
    read = lambda name, *cols: table(spark, folder, name).select(*cols)
    region = read("region", "r_regionkey", "r_name")
    tables = {
        "a_nation": (read("nation", "n_nationkey", "n_name", "n_regionkey"), ","), "b_region": (region, ";"),
        "c_copy": (region, ";"),
        "d_supplier": (read("supplier", "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "N/A").otherwise(F.concat(
            F.lit('a "quoted", name '), "s_suppkey")).alias("label"), (F.col("s_acctbal") > 0).alias("good")), ","),
        "e_customer": (read("customer", "c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("c_acctbal")),
                       "\t"),
        "f_none": (region.where("false"), "|")}
    for name, (t, sep) in tables.items():
        t.coalesce(1).orderBy(t.columns[0]).coalesce(1).write.option("header", True).option("sep", sep).option(
            "escape", '"').csv(f"{path}/{name}")
    lines = read("part", F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.when(
        F.col("p_partkey") % 5 == 0, "too,many")).alias("value")).coalesce(1)
    spark.range(1).select(F.lit("p_partkey,p_size").alias("value")).unionAll(lines).coalesce(1).write.text(f"{path}/g_part.csv")
    return path


@query
def ingested_files(spark, folder):
    """S1–S6 on a folder of differing files: one record for each, copies of known files marked."""
    path = _folder_of_files(spark, folder)
    records = ingest.ingest(spark, f"{path}/*")
    name = lambda c: F.element_at(F.split(c, "/"), -2)
    known = records.where(name(F.col("path")) == "a_nation").select(F.lit("stored").alias("path"), "file_hash")
    found = ingest.accepted(records, known)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select(
        name("path").alias("file"), "delimiter", F.array_join("header", ",").alias("header"), "rows", "bad_lines",
        text(F.col("types")).alias("types"), text(F.col("missing")).alias("missing"),
        F.size("preview").cast("long").alias("previewed"), F.get("preview", F.lit(0))[F.get("header", F.lit(1))].alias("cell"),
        "problem", F.when(F.col("duplicate_of") == "stored", "stored").otherwise(name("duplicate_of")).alias("duplicate_of"))


@query
def null_tokens(spark, folder):
    """S3."""
    t = table(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "error", "N/A").when(
        F.col("event_type") == "click", " null ").when(F.col("event_type") == "view", "None").otherwise(
        F.col("event_type")).alias("label"))
    return csv_source.normalise_nulls(t)


@query
def valid_orders(spark, folder):
    """The checked table."""
    return files.validate(table(spark, folder, "orders")).select("o_orderkey", "o_totalprice")


@query
def file_fingerprints(spark, folder):
    """S5."""
    found = files.file_fingerprint(spark, f"{folder}/*.parquet")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "length", "file_hash")


def _document_files(spark, folder):
    d = table(spark, folder, "documents")
    known = d.join(table(spark, folder, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(
        F.col("source").alias("user_id"), F.sha2("text", 256).alias("file_hash"),
        (F.col("lang") == "de").alias("is_archived"))
    incoming = d.select("doc_id", F.col("source").alias("user_id"), F.sha2("text", 256).alias("file_hash"))
    return files.reject_known_files(incoming, known)


@query
def files_accepted(spark, folder):
    """Files without a known copy."""
    return _document_files(spark, folder)[0].select("doc_id", "user_id")


@query
def files_rejected(spark, folder):
    """Files whose user already has the same content."""
    return _document_files(spark, folder)[1].select("doc_id", "user_id")


@query
def row_index(spark, folder):
    """S7."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return with_row_index(o, ["o_totalprice", "o_orderkey"])


@query
def formula_free_text(spark, folder):
    """Whole conversation texts with a formula prefix by role."""
    c = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(F.when(F.col("role") == "user", " =+ -").otherwise("@"), "text").alias("text"))
    return files.sanitize_formula(c)


@query
def preview_events(spark, folder):
    """S9."""
    return files.preview(table(spark, folder, "events").select("event_id", "user_id", "value"), "event_id", 10)


@query
def findings_written(spark, folder):
    """Findings written twice under one analysis and once under another, read back."""
    path = scratch(spark)
    f = kept(visit_findings(spark, folder).drop("score_text"))
    sinks.write_findings(f, path, "a1", "2024-01-01")
    sinks.write_findings(f, path, "a2", "2024-01-01")
    sinks.write_findings(f.where("severity = 'CRITICAL'"), path, "a1", "2024-01-01")
    return spark.read.parquet(path).groupBy("analysis_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_reviewed")).alias("open"))


@query
def findings_exported(spark, folder):
    """S11."""
    path = scratch(spark)
    sinks.export_csv(visit_findings(spark, folder), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("row_key").cast("long").alias("row_key"), "column_name",
                       F.col("anomaly_score").cast("double").alias("anomaly_score"), "severity", "detection_method")


def _reviewed_store(spark, folder, compacted: bool) -> str:
    """Findings of three analyses with two batches of marks that contradict each other, and a late one with an old date."""
    path, aside = scratch(spark), scratch(spark)
    f = kept(visit_findings(spark, folder).drop("score_text"), aside)
    for name in ("a1", "a2", "a3"):
        sinks.write_findings(f, f"{path}/findings", name, "2024-01-01")
    cells = f.where("severity IN ('CRITICAL', 'HIGH')").select("row_key", "column_name", "severity")
    marked, _ = kept(cells, f"{path}/cells"), removed(f, aside)  # each finding is stored three times by now
    of = lambda name, day, **fields: marked.select(
        F.lit(name).alias("analysis_id"), "row_key", "column_name", "severity", F.lit(day).cast("date").alias("marked_at"),
        *[F.lit(v).alias(k) for k, v in fields.items()])
    reviews.append_marks(of("a1", "2024-02-01", is_reviewed=True, review_note="first").unionByName(
        of("a2", "2024-02-01", is_reviewed=True, review_note="first")), path, 1)
    reviews.append_marks(of("a1", "2024-02-02", review_note="second", is_false_positive=True).where("row_key % 2 = 0"), path, 2)
    if compacted:
        reviews.compact(spark, path)
    reviews.append_marks(of("a1", "2024-01-15", is_reviewed=False, review_note="late").where("severity = 'HIGH'"), path, 3)
    return path


def _review_counts(findings) -> DataFrame:
    return findings.groupBy("analysis_id", "severity", "is_reviewed", "review_note", "is_false_positive").agg(
        F.count(F.lit(1)).alias("n"))


@query
def marks_on_read(spark, folder):
    """Q3, Q4 as an append-only log: the later mark counts, whenever its batch came."""
    return _review_counts(reviews.read_findings(spark, _reviewed_store(spark, folder, False)))


@query
def marks_compacted(spark, folder):
    """Q3, Q4 after compaction of the first two batches; the third one is compacted by itself, in a second run."""
    path = _reviewed_store(spark, folder, True)
    reviews.compact(spark, path)
    return _review_counts(spark.read.parquet(f"{path}/findings"))


# ---- profiling ---------------------------------------------------------------------------------

def _profile(spark, folder, name, cols):
    p = profile.profile(table(spark, folder, name), cols)
    return p.select("column_name", "count", "missing_count", "missing_percent", "unique_count", *[
        F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis")])


@query
def profile_orders(spark, folder):
    """P1."""
    return _profile(spark, folder, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query
def profile_lineitem(spark, folder):
    """P1 on the largest table."""
    return _profile(spark, folder, "lineitem",
                    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


SKETCHED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def stored_sketches(spark, folder) -> DataFrame:
    """Sketches of the line items, one part for each month, stored in two batches; the first month is stored twice."""
    path = scratch(spark)
    lines = table(spark, folder, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    first = lines.agg(F.min("month")).head()[0]
    for part in (lines.where("month < '1995-01'"), lines.where("month >= '1995-01'"), lines.where(F.col("month") == first)):
        sinks.write_sketches(sketches.column_sketches(part, SKETCHED, ["month"]), path, ["month"])
    return spark.read.parquet(path)


@query
def sketched_profile_lineitem(spark, folder):
    """P1 from stored sketches of months: exact counts and moments, distinct counts within their error."""
    p = sketches.sketch_profile(sketches.merged_sketches(stored_sketches(spark, folder)))
    exact = profile.distinct_counts(table(spark, folder, "lineitem"), SKETCHED)
    off = F.element_at(F.create_map(*[x for c in SKETCHED for x in (F.lit(c), F.lit(exact[c]))]), F.col("column_name"))
    return p.select("column_name", "count", "missing_count", *[
        F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "skewness", "kurtosis")],
        (F.abs(F.col("unique_count") - off) <= 1 + sketches.DISTINCT_ERROR * off).alias("unique_close"))


@query
def sketched_quantiles_lineitem(spark, folder):
    """U2, U3, U5 from stored sketches: every quantile's rank, counted on all rows, is within the stated error."""
    qs = (0.01, 0.25, 0.5, 0.75, 0.99)
    stats = sketches.sketch_stats(sketches.merged_sketches(stored_sketches(spark, folder)), qs)
    lines = table(spark, folder, "lineitem")
    found = []
    for c, s in stats.items():
        for q in qs:
            x = F.col(c)
            # of equal values, some rank must be near
            below, upto = F.count_if(x < s.quantile[q]) / F.count(x), F.count_if(x <= s.quantile[q]) / F.count(x)
            found.append(F.struct(F.lit(c).alias("column_name"), F.lit(q).alias("q"), (
                (below <= q + sketches.RANK_ERROR) & (upto >= q - sketches.RANK_ERROR)).alias("close")))
    return lines.agg(F.array(*found).alias("f")).select(F.inline("f"))


@query
def sketched_bounds_lineitem(spark, folder):
    """U5 with ``exact=False``: the share of values outside the two percentiles is within the stated error."""
    lines = table(spark, folder, "lineitem")
    cols = ["l_extendedprice", "l_orderkey"]
    found = univariate.percentile_bounds(lines, LINE_KEY, cols, exact=False).groupBy("column_name").count()
    share = F.col("count") / F.lit(lines.count())
    return found.select("column_name", (F.abs(share - 0.02) <= 2 * sketches.RANK_ERROR + 0.001).alias("close"))


@query
def types_of_visits(spark, folder):
    """P2."""
    found = profile.column_types(visits(spark, folder).select("event_id", "heart_rate", "start_date", "end_date", "site"))
    return spark.createDataFrame(list(found.items()), "column_name string, kind string")


@query
def missing_by_column(spark, folder):
    """P3."""
    return profile.missing_summary(visits(spark, folder))


@query
def missing_share(spark, folder):
    """P4."""
    return profile.missing_percent(visits(spark, folder)).select(F.round("missing_percent", 6).alias("missing_percent"))


@query
def missing_grades(spark, folder):
    """P5."""
    g = profile.missing_grade(visits(spark, folder))
    return g.select("column_name", "missing_count", F.round("percent", 4).alias("percent"), "grade")


@query
def imputed_visits(spark, folder):
    """P6."""
    v = visits(spark, folder).select("event_id", "heart_rate", "weight", "site")
    return profile.impute(v)


@query
def header_concepts(spark, folder):
    """Both header rules on the headers of the visits table."""
    v = visits(spark, folder)
    profile_map, rule_map = mapping.map_columns(v.columns), mapping.map_columns_rules(v.columns)
    counted = v.agg(*[F.count(quoted(c)).alias(c) for c in v.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("header"), F.lit(profile_map.get(c)).alias("concept"),
                              F.lit(rule_map.get(c)).alias("rule_concept"), quoted(c).alias("values")) for c in v.columns])
    return counted.select(F.inline(rows))


@query
def standard_parameters(spark, folder):
    """Names of a long table mapped to concepts."""
    return mapping.standardise_parameters(readings(spark, folder), "parameter", "rules").select(
        "event_id", "parameter", "concept")


# ---- univariate --------------------------------------------------------------------------------

VISIT_NUMBERS = ["heart_rate", "systolic_bp", "weight", "temperature"]


@query
def zscore_events(spark, folder):
    """U1, R1."""
    return shape(univariate.zscore(table(spark, folder, "events"), "event_id", ["value"]))


@query
def zscore_documents(spark, folder):
    """U1 on text lengths."""
    return shape(univariate.zscore(table(spark, folder, "documents"), "doc_id", ["n_chars"]))


@query
def zscore_orders(spark, folder):
    """U1 with a low threshold, two columns."""
    return shape(univariate.zscore(table(spark, folder, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 1.7))


def _lines(h: DataFrame) -> DataFrame:
    return h.select(F.col("row_key.l_orderkey").alias("l_orderkey"), F.col("row_key.l_linenumber").alias("l_linenumber"),
                    F.col("row_key.l_partkey").alias("l_partkey"), "column_name", "method", "score", "z_score",
                    "expected_min", "expected_max")


@query
def zscore_lineitem(spark, folder):
    """U1 with a composite key on the largest table."""
    return _lines(univariate.zscore(table(spark, folder, "lineitem"), LINE_KEY, ["l_extendedprice"], 1.7))


@query
def iqr_events(spark, folder):
    """U2."""
    return shape(univariate.iqr(table(spark, folder, "events"), "event_id", ["value"]))


@query
def modified_zscore_events(spark, folder):
    """U3."""
    return shape(univariate.modified_zscore(table(spark, folder, "events"), "event_id", ["value"]))


@query
def grubbs_statistics(spark, folder):
    """U4: G, extreme row and value per column."""
    g = univariate.grubbs_statistic(visits(spark, folder), "event_id", ["heart_rate", "systolic_bp", "weight"])
    return g.select("row_key", "column_name", "n", "extreme_value", F.round("g", 4).alias("g"))


@query
def grubbs_events(spark, folder):
    """U4: the flagged value."""
    return shape(univariate.grubbs(table(spark, folder, "events"), "event_id", ["value"]))


@query
def percentile_bounds_events(spark, folder):
    """U5."""
    return shape(univariate.percentile_bounds(table(spark, folder, "events"), "event_id", ["value"]))


@query
def percentile_bounds_lineitem(spark, folder):
    """U5 on the largest table."""
    return _lines(univariate.percentile_bounds(table(spark, folder, "lineitem"), LINE_KEY, ["l_extendedprice"]))


@query
def statistical_visits(spark, folder):
    """U6, R2."""
    return shape(univariate.statistical(visits(spark, folder), "event_id", VISIT_NUMBERS))


# ---- missing and impossible --------------------------------------------------------------------

@query
def missing_rates(spark, folder):
    """D1, E5."""
    return missing.missing_rate(visits(spark, folder), "event_id").select("column_name", "score", "anomaly_type", "note")


@query
def missing_values(spark, folder):
    """D2."""
    return missing.missing_cells(visits(spark, folder), "event_id").select(*NOTED)


@query
def impossible_visits(spark, folder):
    """D3, E5."""
    return missing.impossible_values(visits(spark, folder), "event_id").select(*NOTED)


@query
def missing_or_impossible(spark, folder):
    """D4."""
    return missing.missing_all(visits(spark, folder), "event_id").groupBy("column_name", "method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query
def missing_streaks(spark, folder):
    """D5."""
    return missing.missing_streak(visits(spark, folder), "event_id", "subject_id", "visit_time",
                                  ["heart_rate", "weight"], 2).select(*NOTED)


# ---- rules -------------------------------------------------------------------------------------

@query
def range_violations(spark, folder):
    """C1, E5."""
    return rules.range_rules(visits(spark, folder), "event_id", VISIT_RULES).select(
        *NOTED, "expected_min", "expected_max")


@query
def range_violations_long(spark, folder):
    """C1 on a long table of named parameters."""
    named = mapping.standardise_parameters(readings(spark, folder), "parameter", "rules")
    rows = [(c, *[float(v) if v is not None else None for v in (lo, hi)], unit, cl, ch)
            for c, (lo, hi, unit, cl, ch) in CLINICAL_RANGES.items()]
    limits = spark.createDataFrame(
        rows, "concept string, low double, high double, unit string, critical_low double, critical_high double")
    return rules.range_rules_long(named, "event_id", "concept", "value", limits).select(
        "row_key", "column_name", "score", "anomaly_type", "expected_min", "expected_max")


@query
def pressure_order(spark, folder):
    """C2."""
    return rules.field_order(visits(spark, folder), "event_id", "diastolic_bp", "systolic_bp").select(
        *NOTED, "expected_min", "expected_max")


@query
def dates_out_of_order(spark, folder):
    """C3."""
    return rules.date_order(visits(spark, folder), "event_id", "start_date", "end_date").select(*NOTED)


@query
def all_rules(spark, folder):
    """C4."""
    return rules.rules_all(visits(spark, folder), "event_id", "subject_id", "visit_time", VISIT_RULES).groupBy(
        "column_name", "method", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))


# ---- longitudinal ------------------------------------------------------------------------------

@query
def weight_shifts(spark, folder):
    """L1."""
    h = longitudinal.shift_percent(visits(spark, folder), "event_id", "subject_id", "visit_time", "weight")
    return h.select("row_key", "column_name", "score", F.round("expected_min", 4).alias("expected_min"),
                    F.round("expected_max", 4).alias("expected_max"))


@query
def value_folds(spark, folder):
    """L2."""
    h = longitudinal.shift_fold(table(spark, folder, "events"), "event_id", "user_id", "ts", "value")
    return h.select("row_key", "column_name", "score", F.round("expected_min", 4).alias("expected_min"),
                    F.round("expected_max", 4).alias("expected_max"))


@query
def price_folds(spark, folder):
    """L2 on orders by customer."""
    h = longitudinal.shift_fold(table(spark, folder, "orders"), "o_orderkey", "o_custkey", "o_orderdate",
                                "o_totalprice")
    return h.select("row_key", "column_name", "score", F.round("expected_min", 4).alias("expected_min"),
                    F.round("expected_max", 4).alias("expected_max"))


@query
def repeated_temperatures(spark, folder):
    """L3."""
    return longitudinal.repeated_values(visits(spark, folder), "event_id", "subject_id", "visit_time",
                                        "temperature").select(*NOTED)


@query
def repeated_by_slices(spark, folder):
    """L1–L3 with the slicing used for subjects that hold a large share of the rows."""
    h = longitudinal.longitudinal(visits(spark, folder), "event_id", "subject_id", "visit_time",
                                  {"weight": "weight", "temperature": "temperature"}, max_group=20)
    return h.groupBy("column_name", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("row_key").alias("keys"))


# ---- duplicates --------------------------------------------------------------------------------

@query
def exact_copies(spark, folder):
    """X1 on whole texts."""
    return duplicates.exact_duplicates(table(spark, folder, "documents"), "doc_id", ["text", "lang"]).select(
        "row_key", "duplicate_of", "anomaly_score", "anomaly_type")


@query
def exact_copies_with_nulls(spark, folder):
    """X1 with NULLs comparing equal, and hot groups split off."""
    v = visits(spark, folder).select("event_id", "site", "systolic_bp", "weight")
    return duplicates.exact_duplicates(v, "event_id", null_rows="include", hot_rows=5).select("row_key", "duplicate_of")


def _near(d: DataFrame) -> DataFrame:
    return d.select("row_key", "duplicate_of", F.array_join("columns_matching", ",").alias("columns_matching"),
                    "anomaly_score", "anomaly_type")


@query
def near_copies_orders(spark, folder):
    """X2 on all orders."""
    return _near(duplicates.near_duplicates(table(spark, folder, "orders"), "o_orderkey",
                                            ["o_custkey", "o_totalprice"]))


@query
def near_copies_parts(spark, folder):
    """X2 where one of three columns may differ."""
    p = table(spark, folder, "part").withColumn("width", F.length("p_name"))
    return _near(duplicates.near_duplicates(p, "p_partkey", ["p_size", "p_retailprice", "width"], threshold=0.66))


@query
def all_copies(spark, folder):
    """X3."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", -2).alias("balance"))
    return duplicates.duplicates(c, "c_custkey").select("row_key", "duplicate_of", "anomaly_score", "anomaly_type")


# ---- multivariate ------------------------------------------------------------------------------

@query
def isolation_lineitem(spark, folder):
    """M1."""
    r = iforest.isolation_forest(table(spark, folder, "lineitem"), LINE_KEY,
                                 ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return r.select("row_key.l_orderkey", "row_key.l_linenumber", "anomaly_score", "is_anomaly", "raw_score")


@query
def isolation_embeddings(spark, folder):
    """M1 on vectors."""
    return iforest.isolation_forest(table(spark, folder, "embeddings"), "vec_id", vector_col="embedding")


def _properties(scored: DataFrame, n: int, share: float = 0.05) -> DataFrame:
    """(n, lowest, highest, share_close, apart): every row has a score, the scores span 0 to 1, the wanted share is
    flagged, and no flagged row scores below one that is not."""
    flagged = F.col("is_anomaly")
    found = scored.agg(
        F.count(F.lit(1)).alias("n"), F.min("anomaly_score").alias("lowest"), F.max("anomaly_score").alias("highest"),
        F.count_if(flagged).alias("k"), F.min(F.when(flagged, F.col("anomaly_score"))).alias("least"),
        F.max(F.when(~flagged, F.col("anomaly_score"))).alias("most"))
    return found.select("n", "lowest", "highest", (F.abs(F.col("k") - share * n) <= 1 + 0.01 * n).alias("share_close"),
                        (F.col("least") >= F.col("most")).alias("apart"))


@query
def isolation_properties(spark, folder):
    """M1: properties of the scores of all line items."""
    t = table(spark, folder, "lineitem")
    return _properties(iforest.isolation_forest(t, LINE_KEY, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), t.count())


@query
def reconstruction_properties(spark, folder):
    """M3: properties of the scores of all line items."""
    t = table(spark, folder, "lineitem")
    return _properties(reconstruct.reconstruction(t, LINE_KEY, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), t.count())


@query
def lof_customers(spark, folder):
    """M2."""
    return lof.lof(table(spark, folder, "customer"), "c_custkey", ["c_custkey", "c_acctbal"])


@query
def lof_embeddings(spark, folder):
    """M2 on vectors."""
    return lof.lof(table(spark, folder, "embeddings"), "vec_id", vector_col="embedding")


@query
def lof_embeddings_approximate(spark, folder):
    """M2 on vectors, neighbours by random projections."""
    return lof.lof(table(spark, folder, "embeddings"), "vec_id", vector_col="embedding", approx=True)


@query
def lof_neighbour_recall(spark, folder):
    """M2: whether the approximate search finds 95 % of the exact neighbours of every vector of the table."""
    return lof_recall(table(spark, folder, "embeddings"), "vec_id", "embedding")


def lof_recall(df, key, vector_col, k: int = 20, tables: int = lof.TABLES) -> DataFrame:
    """(vectors, k, recalled): whether the approximate search reaches a recall of 0.95 against the exact one."""
    frame = lof.vector_frame(df, key, vector_col=vector_col)
    _, d = lof.shape_of(frame)
    distinct = frame.groupBy("vec").agg(F.min("row_key").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = lof.blocks(distinct, d, lof.BLOCK_ROWS)
    recall = lof.neighbour_recall(lof.nearest_by_projection(placed, d, k, tables, lof.BLOCK_ROWS),
                                  lof.nearest(placed, d, k))
    return placed.agg(F.count(F.lit(1)).alias("vectors")).select(
        "vectors", F.lit(k).cast("long").alias("k"), F.lit(recall >= 0.95).alias("recalled"))


@query
def reconstruction_lineitem(spark, folder):
    """M3."""
    r = reconstruct.reconstruction(table(spark, folder, "lineitem"), LINE_KEY,
                                   ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return r.select("row_key.l_orderkey", "row_key.l_linenumber", "anomaly_score", "is_anomaly",
                    "reconstruction_error")


@query
def reconstruction_embeddings_pca(spark, folder):
    """M3 by principal components."""
    return reconstruct.reconstruction(table(spark, folder, "embeddings"), "vec_id", vector_col="embedding", kind="pca")


# ---- merge, scores, texts ----------------------------------------------------------------------

def visit_hits(spark, folder) -> DataFrame:
    """Hits of the statistical, missing, impossible and rule checks on the visits."""
    v = visits(spark, folder)
    local = hits.emit_all(v, "event_id", [
        univariate.statistical_candidates(v, "event_id", VISIT_NUMBERS), missing.missing_candidates(v, "event_id"),
        missing.impossible_candidates(v, "event_id"), *rules.rule_candidates(v, VISIT_RULES)], "subject_id")
    return local.unionByName(rules.longitudinal(v, "event_id", "subject_id", "visit_time", VISIT_RULES))


def visit_cells(spark, folder, **options) -> DataFrame:
    return ensemble.ensemble(visit_hits(spark, folder), **options)


def visit_findings(spark, folder) -> DataFrame:
    return explain.explain(visit_cells(spark, folder), VISIT_RULES)


@query
def collected_scores(spark, folder):
    """F1: last score per cell and detector."""
    algos = ["statistical", "clinical_rules", "missing_data"]
    cells = ensemble.collect_hits(visit_hits(spark, folder), algorithms=algos)
    return cells.select("row_key", "column_name", *[F.col(a)["score"].alias(a) for a in algos])


@query
def row_scores_on_cells(spark, folder):
    """F2: LOF scores of flagged rows on their numeric cells."""
    c = table(spark, folder, "customer")
    cols = ["c_custkey", "c_acctbal"]
    s = lof.lof(c, "c_custkey", cols, carry=[hits.subject(None), ensemble.cells_of(c, cols)])
    return ensemble.attribute_rows(s, "lof").select("row_key", "column_name", "value", "score")


@query
def duplicate_scores_on_cells(spark, folder):
    """F3."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", -2).alias("balance"))
    d = duplicates.exact_duplicates(c, "c_custkey")
    return ensemble.attribute_duplicates(c, "c_custkey", d).select("row_key", "column_name", "score", "note")


@query
def ensemble_scores(spark, folder):
    """F4, F5, F6."""
    return visit_cells(spark, folder).select("row_key", "column_name", "anomaly_score", "severity")


@query
def ensemble_max_conflict(spark, folder):
    """F4 with the highest rule score per cell instead of the last."""
    return visit_cells(spark, folder, conflict="max").select("row_key", "column_name", "anomaly_score", "severity")


@query
def decorated_findings(spark, folder):
    """F7."""
    return visit_cells(spark, folder).select(
        "row_key", "column_name", "subject_id", "value", F.round("expected_range_min", 4).alias("expected_range_min"),
        F.round("expected_range_max", 4).alias("expected_range_max"), "z_score", "detection_method", "anomaly_type")


def large_ages(df, key) -> DataFrame:
    """A detector of the caller's own: subjects over 150, scored by their age."""
    return df.where("age > 150").select(F.col(key).alias("row_key"), F.lit("age").alias("column_name"), F.col("age").cast(
        "string").alias("value"), F.round(F.col("age") / 200.0, 4).alias("score"), F.lit("large_age").alias("anomaly_type"))


def broken(df, key) -> DataFrame:
    """A detector that fails while it runs, not while it is built."""
    return df.select(F.col(key).alias("row_key"), F.lit("age").alias("column_name"),
                     F.raise_error(F.lit("no such sensor")).cast("double").alias("score"))


def _visit_run(**options) -> AnalysisConfig:
    """The checks of ``visit_hits`` as a run, without the detectors that draw at random."""
    return AnalysisConfig(subject_col="subject_id", timepoint_col="visit_time", columns_to_analyze=VISIT_NUMBERS,
                          column_map=VISIT_RULES, run_isolation_forest=False, run_lof=False, run_autoencoder=False,
                          run_duplicate_check=False, **options)


OWN = [Detector("ages", large_ages, 0.3, rank=15), Detector("sensors", broken)]


@query
def detector_counts(spark, folder):
    """F8: detectors of a real run, one of the caller's own, one that fails."""
    run = analyze(visits(spark, folder), "event_id", _visit_run(detectors=OWN, strict=False))
    return run.algorithms.select("algorithm", "status", "flagged", F.col("error").contains("no such sensor").alias("failed"))


@query
def own_detector_findings(spark, folder):
    """F4, F7, F9 with a detector of the caller's own: its hits are weighted, ranked and named like others."""
    run = analyze(visits(spark, folder), "event_id", _visit_run(detectors=OWN[:1]))
    return run.findings.select("row_key", "column_name", "anomaly_score", "severity", "detection_method", "anomaly_type")


@query
def own_detector_summary(spark, folder):
    """F9 with a detector of the caller's own."""
    return analyze(visits(spark, folder), "event_id", _visit_run(detectors=OWN[:1])).summary


def stored_runs(spark, folder) -> str:
    """A folder with three runs on the visits: one complete, one without the oldest subjects, one that failed."""
    path = scratch(spark)
    v = visits(spark, folder)
    stored_analysis(v, "event_id", path, "whole", _visit_run(), "visits", OWNER)
    stored_analysis(v.where("age <= 100"), "event_id", path, "younger", _visit_run(run_clinical_rules=False), "visits", OWNER)
    try:
        stored_analysis(v, "event_id", path, "broken", _visit_run(detectors=OWN[1:]), "visits", OWNER)
    except Exception as error:  # it is in the record
        if "no such sensor" not in str(error):
            raise
    return path


@query
def stored_records(spark, folder):
    """the records that runs have left, with counts observed while their findings were written."""
    records = sinks.read_records(spark, f"{stored_runs(spark, folder)}/analyses")
    return records.where("analysis_id <> 'younger'").select(
        "analysis_id", "dataset_id", "status", "total_rows", "total_anomalies", "critical", "high", "medium", "low",
        "quality_score", "anomaly_rate_percent", F.col("error").contains("no such sensor").alias("failed"),
        (F.col("processing_time_seconds") > 0).alias("timed"))


@query
def stored_report(spark, folder):
    """Q6, Q7, Q14, Q16 on the records and findings of runs: (section, name, value)."""
    path = stored_runs(spark, folder)
    records, found = sinks.read_records(spark, f"{path}/analyses"), spark.read.parquet(f"{path}/findings")
    tables = results.report_tables(found, profile.profile(visits(spark, folder), VISIT_NUMBERS), records,
                                   quality.recommendations(found.where("analysis_id = 'whole'")),
                                   spark.read.parquet(f"{path}/detectors").where("analysis_id = 'whole'"), "whole")
    sets = datasets(spark, folder).withColumn("user_id", F.col("user_id").cast("string"))
    totals = results.dashboard_totals(sets, records, found, str(OWNER))
    row = lambda section, name, value: (F.lit(section).alias("section"), name.cast("string").alias("name"),
                                        value.cast("string").alias("value"))
    newest = results.recent_analyses(records, sets.withColumn("dataset_id", F.col("dataset_id").cast("string")), str(OWNER), 3)
    parts = [
        tables["executive_summary"].select(*row("summary", F.col("analysis_id"), F.col("total_anomalies"))),
        tables["severity"].select(*row("severity", F.col("severity"), F.col("n"))),
        tables["algorithms"].select(*row("algorithm", F.col("algorithm"), F.col("flagged"))),
        tables["column_statistics"].select(*row("column", F.col("column_name"), F.col("count"))),
        tables["findings"].groupBy("severity").count().select(*row("finding", F.col("severity"), F.col("count"))),
        tables["recommendations"].select(*row("advice", F.col("position"), F.col("recommendation"))),
        tables["timestamps"].select(*row("in order", F.col("analysis_id"), F.col("started_at") <= F.col("completed_at"))),
        totals.select(*row("dashboard", F.lit("analyses"), F.col("total_analyses"))),
        newest.select(*row("newest", F.col("analysis_id"), F.col("status"))),
        results.run_duration(records).select(*row("timed", F.col("analysis_id"), F.col("duration_seconds") > 0))]
    return hits.union_hits(parts)


@query
def finding_summary(spark, folder):
    """F9."""
    return quality.summarise(visit_cells(spark, folder))


@query
def quality_of_visits(spark, folder):
    """F10, F11."""
    return quality.quality_score(visit_cells(spark, folder), visits(spark, folder))


@query
def quality_of_documents(spark, folder):
    """F10, F11 on a table with few findings."""
    d = table(spark, folder, "documents")
    found = ensemble.ensemble(univariate.zscore(d, "doc_id", ["n_chars"], 8.0))
    return quality.quality_score(found, d)


@query
def advice(spark, folder):
    """F12."""
    return quality.recommendations(visit_cells(spark, folder))


@query
def suggested_actions(spark, folder):
    """E1."""
    return visit_findings(spark, folder).select("row_key", "column_name", "suggested_action")


@query
def context_texts(spark, folder):
    """The sentence for every heart rate against fixed limits."""
    v = visits(spark, folder).where("heart_rate IS NOT NULL")
    return v.selectExpr("event_id", explain.context_text("'heart_rate'", "heart_rate", "20.0", "100.0") + " AS context")


@query
def explained_findings(spark, folder):
    """E3."""
    return visit_findings(spark, folder).select("row_key", "column_name", "value", "clinical_significance")


@query
def score_sentences(spark, folder):
    """E4."""
    cells = visit_cells(spark, folder).where("value_num IS NOT NULL")
    return cells.selectExpr("row_key", "column_name", explain.score_text(
        "column_name", "value_num", "CAST(NULL AS DOUBLE)", "0.5", "methods", "expected_range_min",
        "expected_range_max") + " AS score_text")


@query
def full_analysis(spark, folder):
    """every detector on the visits."""
    config = AnalysisConfig(subject_col="subject_id", timepoint_col="visit_time")
    return analyze(visits(spark, folder), "event_id", config).findings.drop("score_text")


# ---- stored results ----------------------------------------------------------------------------

@query
def filtered_findings(spark, folder):
    """R4."""
    f = results.filter_findings(stored_findings(spark, folder), severity="critical", is_reviewed=False)
    return f.select("analysis_id", "row_key", "column_name", "anomaly_score")


@query
def findings_by_method(spark, folder):
    """R5."""
    f = results.filter_findings(stored_findings(spark, folder), detection_method="clinical_rules",
                                is_false_positive=True, min_score=0.5)
    return f.select("analysis_id", "row_key", "column_name", "anomaly_score")


@query
def dataset_search(spark, folder):
    """R6."""
    return results.search_datasets(datasets(spark, folder), "BUILD").select("dataset_id", "name", "original_filename")


@query
def owned_findings(spark, folder):
    """R7."""
    f = results.owned_by(stored_findings(spark, folder), analyses(spark, folder), OWNER)
    return f.select("analysis_id", "row_key", "column_name")


@query
def findings_page(spark, folder):
    """Q1: one page of the findings of the visits."""
    f = results.page_findings(visit_cells(spark, folder), 3, 50)
    return f.select("row_key", "column_name", "anomaly_score", "total", "total_pages")


@query
def findings_counts(spark, folder):
    """Q2."""
    f = stored_findings(spark, folder)
    return results.findings_summary(f)


@query
def reviewed_findings(spark, folder):
    """Q3: every critical finding of customers' first nation reviewed in one batch."""
    f = stored_findings(spark, folder)
    marks = f.where("severity = 'CRITICAL'").select("analysis_id", "row_key", "column_name", F.lit("checked").alias("note"))
    done = results.mark_reviewed(f, marks)
    return done.groupBy("severity", "is_reviewed", "review_note").agg(F.count(F.lit(1)).alias("n"))


@query
def false_positives(spark, folder):
    """Q4: high findings marked, low ones un-marked."""
    f = stored_findings(spark, folder)
    marks = f.where("severity IN ('HIGH', 'LOW')").select(
        "analysis_id", "row_key", "column_name", (F.col("severity") == "HIGH").alias("flag"))
    marks = marks.groupBy("analysis_id", "row_key", "column_name").agg(F.bool_or("flag").alias("flag"))
    done = results.mark_false_positive(f, marks)
    return done.groupBy("severity", "is_reviewed", "is_false_positive").agg(F.count(F.lit(1)).alias("n"))


@query
def dataset_listing(spark, folder):
    """Q5."""
    return results.list_datasets(datasets(spark, folder)).select("dataset_id", "name", "user_id")


@query
def analysis_listing(spark, folder):
    """Q5."""
    return results.list_analyses(analyses(spark, folder), status="COMPLETED").select(
        "analysis_id", "dataset_id", "user_id", "status")


@query
def dashboard(spark, folder):
    """Q6."""
    return results.dashboard_totals(datasets(spark, folder), analyses(spark, folder), stored_findings(spark, folder), OWNER)


@query
def newest_anomalies(spark, folder):
    """Q7."""
    return results.recent_anomalies(stored_findings(spark, folder), analyses(spark, folder), OWNER).select(
        "row_key", "column_name", "severity")


@query
def newest_analyses(spark, folder):
    """Q7."""
    r = results.recent_analyses(analyses(spark, folder), datasets(spark, folder), OWNER)
    return r.select("analysis_id", "status", F.round("quality_score", 4).alias("quality_score"), "dataset_name")


@query
def findings_per_day(spark, folder):
    """Q8."""
    r = results.anomalies_by_day(stored_findings(spark, folder), "1998-12-31")
    return r.select(F.col("day").cast("string").alias("day"), "n")


@query
def platform_counts(spark, folder):
    """Q9."""
    return results.platform_stats(users(spark, folder), datasets(spark, folder), analyses(spark, folder),
                                  stored_findings(spark, folder))


@query
def user_page(spark, folder):
    """Q9: one page of users."""
    return results.list_users(users(spark, folder), 5, 10).select("user_id", "name")


@query
def busiest_columns(spark, folder):
    """Q10."""
    return results.top_columns(stored_findings(spark, folder))


@query
def severity_shares(spark, folder):
    """Q11."""
    return results.severity_breakdown(stored_findings(spark, folder))


@query
def severity_counts(spark, folder):
    """the severity section alone, zeros kept."""
    return quality.by_severity(stored_findings(spark, folder)).select("severity", "n")


@query
def method_counts(spark, folder):
    """findings per single detector."""
    return quality.by_method(stored_findings(spark, folder))


@query
def column_counts(spark, folder):
    """findings per column."""
    return quality.by_column(stored_findings(spark, folder))


@query
def heart_rate_trend(spark, folder):
    """Q12."""
    v = visits(spark, folder)
    flagged = univariate.zscore(v, "event_id", ["heart_rate"])
    t = results.trend(v, flagged, "event_id", "heart_rate", "age", "subject_id")
    return t.select("row_key", "timepoint", "value", "is_anomaly", "subject_id",
                    F.round("expected_min", 4).alias("expected_min"), F.round("expected_max", 4).alias("expected_max"))


@query
def price_histogram(spark, folder):
    """Q13."""
    o = table(spark, folder, "orders")
    flagged = univariate.zscore(o, "o_orderkey", ["o_totalprice"], 1.7)
    h = results.histogram(o, flagged, "o_orderkey", "o_totalprice", 20)
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n", "is_anomaly")


@query
def report_findings(spark, folder):
    """Q14: the report's table of findings."""
    return results.report_findings(visit_findings(spark, folder), 200)


@query
def report_statistics(spark, folder):
    """Q14: the report's column statistics."""
    p = profile.profile(visits(spark, folder).select("event_id", "heart_rate", "weight", "temperature"),
                        ["heart_rate", "weight", "temperature"])
    one = spark.createDataFrame([], "analysis_id long, quality_score double, total_rows long, total_anomalies long, "
                                    "anomaly_rate_percent double, processing_time_seconds double, created_at date, "
                                    "started_at date, completed_at date")
    f = visit_findings(spark, folder).withColumn("analysis_id", F.lit(1))
    t = results.report_tables(f, p, one, f, f, 1)["column_statistics"]
    return t.select("column_name", "count", "missing_percent", *[F.round(c, 3).alias(c) for c in ("mean", "std", "min", "max")])


@query
def quality_bands(spark, folder):
    """Q15: all three band schemes for every analysis."""
    a = analyses(spark, folder)
    return a.select("analysis_id", *[quality.quality_band(F.col("quality_score"), s).alias(s)
                                     for s in ("report", "screen", "label")])


@query
def run_durations(spark, folder):
    """Q16."""
    return results.run_duration(analyses(spark, folder)).select(
        "analysis_id", F.round("duration_seconds", 2).alias("duration_seconds"))


@query
def usage_breaches(spark, folder):
    """Q17."""
    e = table(spark, folder, "events")
    b = results.usage_limit_breaches(e, "user_id", "ts", 1)
    return b.select("user_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "used", "remaining")


# ---- streams -----------------------------------------------------------------------------------

@query
def stream_scores(spark, folder):
    """Events as a stream scored against the baseline of the table."""
    e = table(spark, folder, "events")
    base = score.baseline(e, ["value"])
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    found = score.score_stream(stream, "event_id", base, ("zscore", "iqr"))
    path = scratch(spark)
    return shape(score.run_available(found, f"{path}/hits", f"{path}/state"))


def study_rules(spark) -> DataFrame:
    """Limits of two studies, and common ones for all others."""
    return spark.createDataFrame(
        [("view", "heart_rate", 20.0, 60.0, "bpm", 5.0, None), ("click", "heart_rate", 10.0, 90.0, "bpm", None, 120.0),
         (None, "heart_rate", 15.0, 80.0, "bpm", 2.5, 110.0), (None, "weight", 55.0, 140.0, "kg", None, None)],
        "study string, concept string, low double, high double, unit string, critical_low double, critical_high double")


@query
def ranges_by_study(spark, folder):
    """C1 with limits from a table that differ by study."""
    v = visits(spark, folder).join(table(spark, folder, "events").select("event_id", F.col("event_type").alias("study")),
                                   "event_id")
    concepts = {"heart_rate": "heart_rate", "weight": "weight"}
    return by_table.range_hits(v, "event_id", study_rules(spark), concepts, "study", "subject_id").select(
        "row_key", "column_name", "score", "expected_min", "expected_max", "anomaly_type", "note")


@query
def scores_by_table(spark, folder):
    """U1, U2, U3, U5 with the baseline as a table in the plan."""
    v = visits(spark, folder).select("event_id", *VISIT_NUMBERS)
    return by_table.baseline_hits(v, "event_id", score.baseline(v, VISIT_NUMBERS)).select(
        "row_key", "column_name", "method", "score", "expected_min", "expected_max")


@query
def stream_living_baseline(spark, folder):
    """T1 against stored tables that change between two arrivals: the second half meets half the numbers, other limits."""
    path = scratch(spark)
    e = table(spark, folder, "events").select("event_id", "value")
    rule = lambda low, high: spark.createDataFrame(
        [(None, "reading", low, high, "u", None, None)], study_rules(spark).schema)
    for part, scale, limits in ((0, 1.0, (5.0, 90.0)), (1, 0.5, (10.0, 50.0))):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        score.baseline(e.withColumn("value", F.col("value") * scale), ["value"]).write.mode("overwrite").parquet(f"{path}/base")
        rule(*limits).write.mode("overwrite").parquet(f"{path}/rules")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        score.score_arrivals(stream, "event_id", f"{path}/base", f"{path}/out", f"{path}/state", f"{path}/rules",
                             {"value": "reading"})
    return spark.read.parquet(f"{path}/out").select("row_key", "method", "score", "expected_min")


@query
def stream_usage(spark, folder):
    """Q17 on a stream with a watermark; hours the watermark has closed."""
    e = table(spark, folder, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = score.usage_stream(timed, "user_id", "ts", 1).select(
        "user_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "used", "remaining")
    path = scratch(spark)
    return score.run_available(found, f"{path}/out", f"{path}/state")
