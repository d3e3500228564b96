"""Sources and sinks for videos and their indexes."""
