"""Sources and sinks: the versioned store, directory ingestion and JSON records."""
