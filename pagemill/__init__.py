"""Page-to-dataset operators on Spark.

Every operator takes a DataFrame (or Columns) and returns a DataFrame (or a
Column). Pages, payloads and captured bodies are rows; detection runs as
projections over one row per page, so it needs no shuffle; what crosses rows is
expressed as joins, aggregates and windows with a partial step before the
exchange.
"""
