"""corpusloom: document ingestion, retrieval and evaluation as Spark jobs.

Every operator takes and returns DataFrames; the heavy work is Spark SQL
expressions, joins, windows and Arrow batches on the executors.
"""

from corpusloom.session import build_session, shared_dir, stage

__all__ = ["build_session", "shared_dir", "stage"]
