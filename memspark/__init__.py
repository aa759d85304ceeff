"""memspark: fact stores, hybrid retrieval and conversation analytics as Spark jobs."""
