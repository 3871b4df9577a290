"""Re-identification analytics on Spark: manifests, splits, retrieval, fusion, statistics and gates."""
