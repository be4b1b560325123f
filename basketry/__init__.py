"""Customer and transaction analytics on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects;
nothing builds a dense user-item matrix and nothing collects a table whole
to the driver.
"""

__version__ = "0.1.0"
