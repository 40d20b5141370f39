"""Files, JDBC, configuration and table schemas."""
