"""corpusloom: corpus analytics and retrieval written as Spark DataFrame jobs."""
