"""Sources and sinks: measurements, load documents, datasets with their metadata."""
