"""A Spark-first engine for building and querying a multimodal knowledge base."""
