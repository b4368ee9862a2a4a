"""Few-shot quantitation over fixed-length arrays, as Spark DataFrame jobs."""
