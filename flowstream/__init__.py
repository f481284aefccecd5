"""flowstream: data preparation, online scoring and drift analysis of flow records on Spark."""
