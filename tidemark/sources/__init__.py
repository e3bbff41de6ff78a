"""Sources and sinks of landed files."""
