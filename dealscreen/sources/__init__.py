"""Sources and sinks: landing files, result pages, saved web pages, portals, incremental pulls."""
