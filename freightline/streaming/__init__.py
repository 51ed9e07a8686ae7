"""Structured Streaming pipelines (SS rows).  Every transform here is a plain
DataFrame function, so the same code runs on a static batch (used by the
oracle checks) and on a ``readStream`` source (used by the stream tests)."""
