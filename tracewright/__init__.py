"""tracewright: log and archive analytics on Spark."""
