"""Tables in and out: Parquet, tab-separated edges, JSON lines, write-once sinks."""
