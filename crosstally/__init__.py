"""Data reconciliation, repair and operational history analytics as Spark jobs."""
