"""lakegauge: data profiling, quality, relationship and modelling analytics on Spark.

Every operator is a function over DataFrames.  Nothing here collects data rows:
metric tables stay DataFrames keyed by ``(table_name, column_name)`` and the
driver only ever holds schemas.
"""
