"""brightcask: business analytics and corpus preparation as plain PySpark jobs."""
