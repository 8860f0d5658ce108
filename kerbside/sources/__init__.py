"""Sources and sinks: record fixture, CSV reader, snapshot JSON reader/writer,
GeoJSON/report writers, synthetic generator."""
