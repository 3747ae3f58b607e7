"""Early-warning analytics on daily machine logs, written as Spark jobs."""
