"""kgprep: prepare multi-lingual RDF knowledge graphs for embedding models on Spark.

Every operator is a function from DataFrames to a DataFrame (or a writer of
one), so a whole job stays one lazy Catalyst plan until a sink runs it.
"""

from kgprep.session import checkpoint_dir, scratch_path, session

__all__ = ["checkpoint_dir", "scratch_path", "session"]
