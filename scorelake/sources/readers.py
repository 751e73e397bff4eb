"""Sources. Every reader has an explicit schema; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text import bare_symbol
from scorelake.operators.ranking import first_rows
from scorelake.schemas import MODEL_FILE, PLATE_PAYLOAD, RESULT_ROW, as_struct

def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_samples(spark: SparkSession, path: str, schema: str | T.StructType, max_samples: int | None = None) -> DataFrame:
    """JSONL samples: blank lines are skipped, a malformed line fails the job, first N by sample id."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if max_samples is None else first_rows(rows, max_samples, "sample_id")


def read_results(spark: SparkSession, path: str, schema: str | T.StructType = RESULT_ROW) -> DataFrame:
    """JSONL result rows; an absent path is an empty table.

    Only a line that is no JSON object is dropped. A field of another type is cast where it can be and null
    where it cannot, so the rest of its row stays; a repeat that is no number counts as 0.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    objects = _parsed_lines(spark, path).where(_is_object(F.col("v")))
    return objects.select(*[_result_field(f).alias(f.name) for f in as_struct(schema).fields])


def bad_line_count(spark: SparkSession, path: str) -> DataFrame:
    return _parsed_lines(spark, path).agg(F.count_if(~_is_object(F.col("v"))).alias("bad_lines"))


def _parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _result_field(field: T.StructField) -> Column:
    v, path = F.col("v"), f"$['{field.name}']"
    if field.name == "task_metrics":
        return _metric_list(v, path)
    value = F.try_variant_get(v, path, field.dataType.simpleString())
    if field.name == "repeat_idx":
        value = F.coalesce(value, F.try_variant_get(v, path, "double").try_cast("int"), F.when(F.try_variant_get(v, path, "variant").isNotNull(), F.lit(0)))
    return value


def _metric_list(v: Column, path: str) -> Column:
    """Metrics as (name, value) entries, from such a list or from an object of values by name."""
    value = lambda x: F.try_variant_get(x, "$", "double")
    by_name = F.transform(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), value(e["value"]).alias("value")))
    listed = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda e: F.struct(
        F.try_variant_get(e, "$.name", "string").alias("name"), F.try_variant_get(e, "$.value", "double").alias("value")))
    return F.coalesce(listed, by_name)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


NEWS_COLUMNS = [
    "news_id", "trade_date", "ticker", "sec_short_name", "exchange_cd", "news_publish_time", "news_title",
    "news_body", "news_summary", "sentiment", "sentiment_score",
]


def read_news(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    return select_news(spark.read.parquet(path), max_rows)


def select_news(news: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Pruned and filtered at the scan, in id order; without a row limit no sort is made."""
    from scorelake.operators.checks import non_empty

    rows = non_empty(news.select(*NEWS_COLUMNS), "news_body", "news_summary")
    return rows if max_rows is None else first_rows(rows, max_rows, "news_id")


def read_plate_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("plates", "stocks", "industrial_chains", "question_answers")}


def read_plate_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLATE_PAYLOAD).option("mode", "FAILFAST").json(path)


# Fixed value: the code of a good payload.
PAYLOAD_OK = 20000


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    return payloads.where(~F.col("code").eqNullSafe(PAYLOAD_OK)).select("code", "message", F.col("data.id").alias("plate_id"))


def newest_payloads(payloads: DataFrame, landed: str) -> DataFrame:
    """Of each plate's good payloads the one that landed last; on a tie the one whose text has the larger digest.

    Payloads without a plate are left out. The pick is one aggregate, so a payload is parsed once, its digest is taken once, and only the best of each task
    is moved.
    """
    good = payloads.where(F.col("code") == PAYLOAD_OK).select(F.col("data.id").alias("_plate"), F.struct("*").alias("_row"))
    order = F.struct(F.col("_row")[landed].alias("at"), F.sha2(F.to_json("_row.data"), 256).alias("digest"))
    return good.where("_plate is not null").groupBy("_plate").agg(F.max_by("_row", order).alias("_row")).select("_row.*")


def split_payloads(payloads: DataFrame, updated_at: Column) -> dict[str, DataFrame]:
    """Landed payloads to the four relational tables; rows with another code go to rejected_payloads()."""
    good = payloads.where(F.col("code") == PAYLOAD_OK).select("data")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    child = lambda name: good.select(F.col("data.id").alias("plate_id"), F.explode(f"data.{name}").alias("c"))
    d = lambda c: F.col(f"data.{c}")
    plates = good.select(
        d("id").alias("id"),
        *[F.coalesce(d(c), F.lit("")).alias(c) for c in ("name", "desc")],
        d("subject_id").alias("subject_id"),
        *[F.coalesce(d(c), F.lit("")).alias(c) for c in ("create_name", "update_name")],
        *[d(c).alias(c) for c in ("avg_pcp", "core_avg_pcp", "rise_count", "fall_count", "stay_count", "fund_flow")],
        d("has_north").cast("int").alias("has_north"),
        d("core_stocks_count").alias("core_stocks_count"),
        d("hang_ye_long_tou_stocks_count").alias("hang_ye_long_tou_stocks_count"),
        updated_at.alias("updated_at"),
    )
    stocks = child("stocks").select(
        "plate_id", bare_symbol(F.col("c.symbol")).alias("symbol"), blank("c.desc").alias("desc"),
        blank("c.desc_url").alias("desc_url"), "c.industrial_chain_id", flag("c.is_new").alias("is_new"),
        flag("c.need_pay").alias("need_pay"), "c.core_flag",
    )
    chains = child("industrial_chains").select("plate_id", F.col("c.id").alias("chain_id"), "c.name", "c.order")
    answers = child("question_answers").select("plate_id", "c.question", blank("c.html_answer").alias("html_answer"))
    return {"plates": plates, "stocks": stocks, "industrial_chains": chains, "question_answers": answers}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return models_from_file(spark.read.schema(MODEL_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path))


def models_from_file(registry: DataFrame) -> DataFrame:
    """Registry file to one row per model; the whole entry, whatever its keys, is kept as a text map of defaults."""
    entry = registry.select("active", F.explode("models").alias("model_id", "m"))
    texts = F.try_variant_get("m", "$", "map<string,string>")
    return entry.select(
        "model_id",
        F.coalesce(F.try_variant_get("m", "$.provider", "string"), F.lit("unknown")).alias("provider"),
        F.map_filter(texts, lambda k, v: (k != "price_config") & v.isNotNull()).alias("default_params"),
        F.try_variant_get("m", "$.price_config", "struct<input_per_1k:double,output_per_1k:double>").alias("price_config"),
        F.try_variant_get("m", "$.api_key", "string").alias("api_key"),
        (F.col("model_id") == F.col("active")).alias("is_active"),
    )


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Plain SHA-256 and length per file, which one task reads whole, of 2 GB at most; ``fingerprints.tree_fingerprints`` takes files of any size."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("dataset_rows"))


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count plus a digest of the rows that does not depend on their order or on file layout.

    Every row is hashed with SHA-256; two 60-bit slices of the hashes are summed exactly and the sums hashed.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)
    part = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(part(1).alias("a"), part(16).alias("b")).agg(
        F.count("*").alias("dataset_rows"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    joined = F.concat_ws(":", F.col("dataset_rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select("dataset_rows", F.sha2(joined, 256).alias("dataset_sha256"))


def normalize_calls(raw: DataFrame) -> DataFrame:
    """Recorded call rows: text, token usage with total = in + out, null-safe error fields."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    zero = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in raw.columns else F.lit(0)
    return raw.withColumns({
        "content": F.coalesce(F.col("content"), F.lit("")),
        "prompt_tokens": zero("prompt_tokens"),
        "completion_tokens": zero("completion_tokens"),
        "total_tokens": zero("prompt_tokens") + zero("completion_tokens"),
        "latency_ms": F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)),
        "success": F.coalesce(F.col("success"), F.lit(False)),
        "retry_count": zero("retry_count"),
        **{c: blank(c) for c in ("error", "error_type", "error_stage", "error_code")},
    })


def read_by_model(spark: SparkSession, folder: str, task_name: str, model_id: str, schema: str | T.StructType = RESULT_ROW) -> DataFrame:
    """One model's results; the filter is on partition folders, so other folders are not read."""
    own = T.StructType([f for f in as_struct(schema).fields if f.name not in ("task_name", "model_id")])
    rows = spark.read.schema(own).option("basePath", folder).json(folder)
    safe = model_id.replace("/", "-").replace(":", "-")
    return rows.where((F.col("task_name") == task_name) & (F.col("model_id") == safe))
