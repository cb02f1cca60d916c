"""Sources (event sources, profile scans, framed-stream scans, bench result scans) and sinks."""
