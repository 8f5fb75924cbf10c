"""Security and governance analytics over text, source code and policy tables, as Spark DataFrame operators."""
