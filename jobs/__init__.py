"""Runnable jobs over given tables. Each has run(spark, ...), a command line and a config file of its name."""
