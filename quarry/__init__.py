"""quarry: a Spark-native engine for building and curating a searchable
corpus of structured text records.

Every public operator takes and returns DataFrames; the work runs on Spark
(Catalyst plans, native expressions, Arrow-batched pandas UDFs only where no
built-in expression can express the semantics).
"""

from quarry.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
