from defectlab.streaming.ingest import stream_changes  # noqa: F401
