"""Context retrieval, allocation and corpus preparation as Spark plans."""
