"""Readers for the two original CSV layouts (customers, invoice lines).

Schemas are declared, never inferred. The invoice file is latin-1 encoded
and keeps CustomerID as text such as ``17850.0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column layout of the customer CSV.
CUSTOMER_CSV_SCHEMA = T.StructType(
    [T.StructField("customerID", T.StringType())]
    + [T.StructField("gender", T.StringType()),
       T.StructField("SeniorCitizen", T.IntegerType()),
       T.StructField("Partner", T.StringType()),
       T.StructField("Dependents", T.StringType()),
       T.StructField("tenure", T.IntegerType()),
       T.StructField("PhoneService", T.StringType()),
       T.StructField("MultipleLines", T.StringType()),
       T.StructField("InternetService", T.StringType()),
       T.StructField("OnlineSecurity", T.StringType()),
       T.StructField("OnlineBackup", T.StringType()),
       T.StructField("DeviceProtection", T.StringType()),
       T.StructField("TechSupport", T.StringType()),
       T.StructField("StreamingTV", T.StringType()),
       T.StructField("StreamingMovies", T.StringType()),
       T.StructField("Contract", T.StringType()),
       T.StructField("PaperlessBilling", T.StringType()),
       T.StructField("PaymentMethod", T.StringType()),
       T.StructField("MonthlyCharges", T.DoubleType()),
       T.StructField("TotalCharges", T.StringType()),
       T.StructField("Churn", T.StringType())]
)

TRANSACTION_CSV_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer table as read; TotalCharges stays text (see X1)."""
    return spark.read.schema(CUSTOMER_CSV_SCHEMA).option("header", True).csv(path)


def read_customers_csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    """S3: audit view, every column as text, nothing cleaned."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in CUSTOMER_CSV_SCHEMA])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_transactions_csv(spark: SparkSession, path: str,
                          timestamp_format: str | None = None) -> DataFrame:
    """Invoice lines, latin-1; X6 timestamp parse and X7 nullable id cast."""
    df = (spark.read.schema(TRANSACTION_CSV_SCHEMA)
          .option("header", True).option("encoding", "ISO-8859-1").csv(path))
    ts = (F.to_timestamp_ntz(F.col("InvoiceDate"), F.lit(timestamp_format))
          if timestamp_format else F.to_timestamp_ntz(F.col("InvoiceDate")))
    return (df.withColumn("InvoiceDate", ts)
              .withColumn("CustomerID", F.expr("try_cast(try_cast(CustomerID AS DOUBLE) AS BIGINT)")))
