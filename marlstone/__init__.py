"""Document retrieval on Spark: ingest, index, search, fuse, rerank, pack, evaluate."""

__version__ = "0.1.0"
