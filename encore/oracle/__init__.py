"""Reference SQL for the correctness gate, written for DuckDB and independent of the Spark code."""
