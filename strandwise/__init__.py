"""strandwise: graph, retrieval, entity-resolution and time-travel analytics as Spark plans."""
