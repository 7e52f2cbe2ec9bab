"""Table scans, derived inputs and sinks."""
