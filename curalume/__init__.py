"""Media and text curation as Spark jobs."""
