from basketry.sources.tables import read_table, TABLES
from basketry.sources.bind import raw_transactions, customers_raw
from basketry.sources.files import (
    CUSTOMER_CSV_SCHEMA, TRANSACTION_CSV_SCHEMA, read_customers_csv,
    read_transactions_csv, read_customers_csv_as_text,
)

__all__ = [
    "read_table", "TABLES", "raw_transactions", "customers_raw",
    "CUSTOMER_CSV_SCHEMA", "TRANSACTION_CSV_SCHEMA", "read_customers_csv",
    "read_transactions_csv", "read_customers_csv_as_text",
]
