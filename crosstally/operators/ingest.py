"""From raw payload rows to valid inventory rows and a quarantine."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute_rules, money_from_decimal, parse_utc, text_error, valid_currency, valid_quantity, valid_sku
from ..schemas import NORMALIZED_SCHEMA
from ..sources.batches import MAX_BYTES, MAX_ROWS, text_bytes

MAX_BATCH_ROWS, MAX_BATCH_BYTES = MAX_ROWS, MAX_BYTES
MAX_PARTITIONS = 1024
_PAYLOAD = "struct<sku:string,name:string,quantity:string,unit_price:struct<amount:string,currency:string,exponent:int>,updated_at:string,attributes:map<string,string>>"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row: a generator keeps the optimiser from copying their expressions to every use."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("once_")
    return df.select("*", made).select(*df.columns, *[F.col(f"once_.{name}").alias(name) for name in columns])


def _composed(name: Column, key: Column, values: Column) -> Column:
    """struct(name, key, values) in NFC form: all texts of a row in one exchange with Python."""

    @F.pandas_udf("name string, key string, values array<string>")
    def composed(names: pd.Series, keys: pd.Series, lists: pd.Series) -> pd.DataFrame:
        form = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t)
        return pd.DataFrame({"name": [form(t) for t in names], "key": [form(t) for t in keys], "values": [None if a is None else [form(t) for t in a] for a in lists]})

    return composed(name, key, values)


def normalize_inventory(raw: DataFrame) -> DataFrame:
    """Typed columns of each payload, and ``errors``: the names of all rules that its row breaks."""
    rows = raw.select("record_index", "connector_id", "source_record_key", "payload_json").hint("rebalance")  # a small file has many rows, and its rows much work
    x = _once(rows, p=F.from_json("payload_json", _PAYLOAD))
    attributes = F.coalesce(F.col("p.attributes"), F.create_map().cast("map<string,string>"))
    x = x.select("*", _composed(F.col("p.name"), F.col("source_record_key"), F.map_values(attributes)).alias("c"))
    items = F.zip_with(F.map_keys(attributes), F.col("c.values"), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    units, currency, exponent = (F.col(f"p.unit_price.{k}") for k in ("amount", "currency", "exponent"))
    x = _once(
        x,
        money=money_from_decimal(units, currency, exponent),
        attrs=attribute_rules(items),
        at=parse_utc(F.col("p.updated_at")),
        name_error=text_error(F.col("c.name"), 160, 320),
        key_error=text_error(F.col("c.key"), 128, 256),
        sku_ok=valid_sku(F.col("p.sku")),
        quantity=F.when(valid_quantity(F.col("p.quantity")), F.col("p.quantity").try_cast("int")),
        currency_ok=valid_currency(currency),
    )
    broken: list[Column] = [
        F.when(F.col("p").isNull() | F.col("p.sku").isNull() & F.col("p.name").isNull(), "payload"),
        F.when(~F.col("sku_ok"), "sku"),
        F.when(F.col("name_error").isNotNull(), F.concat(F.lit("name_"), F.col("name_error"))),
        F.when(F.col("quantity").isNull(), "quantity"),
        F.when(~F.col("currency_ok"), "currency"),
        F.when(F.col("money").isNull(), "unit_price").when(F.col("money.units") < 0, "negative_price"),
        F.when(F.col("at").isNull(), "updated_at"),
        F.when(F.col("key_error").isNotNull(), "source_record_key"),
        F.when(F.col("attrs.error").isNotNull(), F.concat(F.lit("attributes_"), F.col("attrs.error"))),
    ]
    return x.select(
        "record_index", F.col("p.sku").alias("sku"), F.when(F.col("name_error").isNull(), F.col("c.name")).alias("name"), "quantity",
        F.col("money.units").alias("unit_price_minor_units"), F.col("money.currency").alias("unit_price_currency"), F.col("money.exponent").alias("unit_price_exponent"), F.col("at").alias("updated_at"), "connector_id",
        F.when(F.col("key_error").isNull(), F.col("c.key")).alias("source_record_key"), F.col("attrs.value").alias("attributes"), "payload_json", F.array_compact(F.array(*broken)).alias("errors"),
    )


def validate_and_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): rows without errors in the normalized schema, and the others with their reasons."""
    return df.filter(F.size("errors") == 0).select(*NORMALIZED_SCHEMA.names), df.filter(F.size("errors") > 0).select("record_index", "connector_id", "source_record_key", "payload_json", "errors")


def assign_record_index(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """record_index 0, 1, 2 ... within each batch. A batch has at most MAX_BATCH_ROWS rows, so its window is small."""
    return df.withColumn("record_index", (F.row_number().over(Window.partitionBy(*partition_cols).orderBy(*order_cols)) - 1).cast("long"))


def check_record_index(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Batches whose indexes are not 0 to n - 1, once each."""
    g = df.groupBy(*partition_cols).agg(F.min("record_index").alias("low"), F.max("record_index").alias("high"), F.count("*").alias("n"), F.count_distinct("record_index").alias("different"))
    return g.filter("low <> 0 or high <> n - 1 or different <> n or low is null")


def check_batch_limits(df: DataFrame, batch_cols: Sequence[str], max_rows: int = MAX_BATCH_ROWS, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Batches with too many rows or too many bytes of text."""
    g = df.groupBy(*batch_cols).agg(F.count("*").alias("n"), F.sum(text_bytes(df)).alias("text_bytes"))
    return g.filter((F.col("n") > max_rows) | (F.col("text_bytes") > max_bytes))


def partition_key(i: Column) -> Column:
    return F.concat(F.lit("partition-"), F.lpad(i.cast("string"), 8, "0"))


def assign_partition(df: DataFrame, key_cols: Sequence[str], n: int = 1) -> DataFrame:
    """partition_key of each row: one of n fixed keys, by the hash of its key columns."""
    if not 1 <= n <= MAX_PARTITIONS:
        raise ValueError("n is 1 to 1024")
    return df.withColumn("partition_key", partition_key(F.pmod(F.xxhash64(*key_cols), F.lit(n))))


def pipeline_metrics(normalized: DataFrame, *keys: str) -> DataFrame:
    """Rows read, written and quarantined and bytes of payload read, in one pass over the normalised rows."""
    bad = F.size("errors") > 0
    size = F.coalesce(F.octet_length("payload_json"), F.lit(0))
    return normalized.groupBy(*keys).agg(F.count("*").alias("records_read"), F.count_if(~bad).alias("records_written"), F.count_if(bad).alias("records_quarantined"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_read"))


def quarantine_reasons(normalized: DataFrame) -> DataFrame:
    return normalized.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def frame_differences(written: DataFrame, read: DataFrame) -> DataFrame:
    """The rows, with their copies, that only one of two frames has."""
    return written.exceptAll(read).withColumn("only_in", F.lit("written")).unionByName(read.exceptAll(written).withColumn("only_in", F.lit("read")))


def round_trip_differences(df: DataFrame, path: str) -> DataFrame:
    """Writes df to a new folder, reads it again and gives the rows that only one of the two has."""
    df.write.mode("errorifexists").parquet(path)
    return frame_differences(df, df.sparkSession.read.schema(df.schema).parquet(path))
