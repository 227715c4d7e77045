"""Named queries over the driver's tables, each with the SQL that an independent engine runs for comparison."""
