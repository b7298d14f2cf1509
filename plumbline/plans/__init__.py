"""Plan-level helpers and end-to-end jobs."""
