"""vellum: curation, de-duplication and search over document collections, as Spark DataFrame jobs."""
