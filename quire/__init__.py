"""Source-grounded indexing of paginated transcripts on Spark."""
