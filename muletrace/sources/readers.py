"""Readers for ledgers kept as JSON documents or tables, and for the live event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.functions.exprs import iso_parse
from muletrace.schemas import PROFILE_SCHEMAS, assert_contract, identifier_rules, ledger_rules


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find the path; one without a scheme is on the cluster's default file system."""
    try:
        spark.read.text(path).schema  # noqa: B018 - looked up when the schema is asked for
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_documents(spark: SparkSession, path: str, table: str) -> DataFrame:
    """JSON-array or line-delimited documents with the table's fixed schema; malformed text fails the read.

    ``_id`` and ``id`` are both accepted.
    """
    df = spark.read.schema(PROFILE_SCHEMAS[table]).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if "_id" in df.columns:
        df = df.withColumn("id", F.coalesce("_id", "id")).drop("_id")
    return df


def load_profile(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """Tables of a profile folder. A missing file gives an empty table, a missing folder None."""
    if not path_exists(spark, folder):
        return None
    out = {}
    for table, schema in PROFILE_SCHEMAS.items():
        path = f"{folder}/{table}.json"
        if path_exists(spark, path):
            out[table] = read_documents(spark, path, table)
        else:
            empty = spark.createDataFrame([], schema)
            out[table] = empty.withColumn("id", F.coalesce("_id", "id")).drop("_id") if "_id" in empty.columns else empty
    return out


def to_ledger(documents: DataFrame, unit: str = "paise") -> DataFrame:
    """Transaction documents -> ledger rows. The money unit is declared, never guessed from the amount."""
    factor = {"paise": 1, "rupees": 100}[unit]
    ts = iso_parse(F.col("ts"))
    return documents.select(
        F.col("id").alias("txn_id"),
        F.col("from").alias("src"),
        F.col("to").alias("dst"),
        (F.col("amount_paise") * factor).alias("amount_paise"),
        ts.alias("ts"),
        F.unix_micros(ts.cast("timestamp")).alias("us"),
        "channel",
        F.col("location.city").alias("city"),
        F.col("location.lat").alias("lat"),
        F.col("location.lng").alias("lng"),
        F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"),
    )


def to_accounts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("id").alias("account"),
        "holder",
        "bank",
        F.unix_micros(iso_parse(F.col("opened_at")).cast("timestamp")).alias("opened_us"),
        F.col("opening_balance").alias("opening_balance_paise"),
        F.col("home.city").alias("home_city"),
        F.col("home.lat").alias("home_lat"),
        F.col("home.lng").alias("home_lng"),
    )


def to_links(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("identifier_id"), "type", F.explode("account_ids").alias("account")).distinct()


def checked_profile(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A profile as engine tables; any contract violation fails the whole load."""
    docs = load_profile(spark, folder)
    if docs is None:
        raise FileNotFoundError(folder)
    return {
        "accounts": to_accounts(docs["accounts"]),
        "ledger": assert_contract(to_ledger(docs["transactions"]), ledger_rules(), "transactions"),
        "links": assert_contract(to_links(docs["identifiers"]), identifier_rules(), "identifiers"),
        "ground_truth": docs["ground_truth"].select("ring_id", "pattern", F.explode("member_ids").alias("account"), "victim_txn_id"),
    }


# ---- live stream --------------------------------------------------------------------------------------------------

_TXN = "struct<id:string,from:string,to:string,amount_paise:bigint,ts:string,channel:string,location:struct<city:string,lat:double,lng:double>>"
LINE = (
    "type string, ts string, id string, kind string, account_id string, run_id string, reason string, "
    "account struct<id:string,holder:string,bank:string,opened_at:string,opening_balance:bigint,home:struct<city:string,lat:double,lng:double>>, "
    f"txn {_TXN}, gt struct<is_fraud:boolean,ring:string>, "
    "ring string, pattern string, member_ids array<string>, victim_txn_id string, victim_amount_paise bigint, planted_at string"
)
RAW_LINE = T.StructType([T.StructField("value", T.StringType())])


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines of JSON files arriving in a folder."""
    return spark.readStream.schema(RAW_LINE).option("maxFilesPerTrigger", files_per_trigger).text(folder)


def kafka_lines(spark: SparkSession, servers: str, topic: str, per_trigger: int = 5_000_000) -> DataFrame:
    """The same lines from Kafka (needs Spark's Kafka package on the cluster)."""
    src = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return src.option("maxOffsetsPerTrigger", per_trigger).load().select(F.col("value").cast("string").alias("value"))


def fan_out(lines: DataFrame, seen: Callable[[DataFrame, Column], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Typed branches of one stream. Labels travel only in ``truth`` and ``labels``; ``txn`` carries none. ``seen`` may count the
    lines before they part; it is told which are of no known type."""
    e = lines.select(F.from_json("value", LINE).alias("e"), "value")
    known = ("run", "account", "identifier", "txn", "truth", "clock", "end")
    unknown = F.col("e.type").isNull() | ~F.col("e.type").isin(*known)
    e = seen(e, unknown) if seen else e
    txn = e.where(F.col("e.type") == "txn")
    return {
        "txn": txn.select("e.txn.*").select(
            F.col("id").alias("txn_id"),
            F.col("from").alias("src"),
            F.col("to").alias("dst"),
            "amount_paise",
            "ts",
            "channel",
            F.col("location.city").alias("city"),
            F.col("location.lat").alias("lat"),
            F.col("location.lng").alias("lng"),
        ),
        "labels": txn.select(F.col("e.txn.id").alias("txn_id"), F.col("e.gt.is_fraud").alias("is_fraud")),
        "account": e.where(F.col("e.type") == "account").select("e.account.*"),
        "identifier": e.where(F.col("e.type") == "identifier").select(
            F.col("e.id").alias("identifier_id"), F.col("e.kind").alias("type"), F.col("e.account_id").alias("account")
        ),
        "truth": e.where(F.col("e.type") == "truth").select(
            F.col("e.ring").alias("ring_id"), "e.pattern", F.explode("e.member_ids").alias("account"), "e.planted_at"
        ),
        "clock": e.where(F.col("e.type") == "clock").select("e.ts"),
        "unknown": e.where(unknown).select("value"),
    }
