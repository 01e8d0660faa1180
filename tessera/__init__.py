"""Document analytics on Spark: filters, search, logs and training-data operators."""
