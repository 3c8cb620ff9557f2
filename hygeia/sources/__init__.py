"""Sources and sinks: table readers, the driver-table fixture views, keyed upserts."""
