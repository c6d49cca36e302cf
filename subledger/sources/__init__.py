"""L0 sources: explicit schemas, CSV readers and table sinks, test-table mapping."""
