"""Sources and sinks: snapshots at rest, JDBC, and the driver tables viewed as the domain."""
