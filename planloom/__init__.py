"""planloom: relational, spatial and sequence operators for capture data, written for Spark."""
