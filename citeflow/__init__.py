"""citeflow: bibliographic-reference resolution as Spark jobs."""
