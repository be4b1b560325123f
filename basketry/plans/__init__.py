"""Query catalog: named Spark plans over the test tables, each paired (where
SQL can express it) with an equivalent DuckDB SQL oracle."""
