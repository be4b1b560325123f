"""Structured Streaming jobs: file source -> foreachBatch -> versioned
tables.  Every per-batch write overwrites only its own ``batch_id``
partition, so a replayed micro-batch leaves the tables unchanged."""
