"""quarry: document-ingest, workflow-graph and run-event analytics on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from the
DataFrame API, so Catalyst plans it, prunes columns, pushes filters into the
parquet scan and AQE picks join strategies at run time.
"""

__all__ = ["session"]
