"""millrace: byte-stream analytics and corpus preparation written as Spark jobs."""
