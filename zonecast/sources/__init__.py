"""Sources and sinks: typed raw-trip reads, table loading, writers."""
