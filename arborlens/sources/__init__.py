"""Sources and sinks: files, extracted rows, graph tables."""
