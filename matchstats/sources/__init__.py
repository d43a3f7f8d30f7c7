"""Sources and sinks of replay records."""
