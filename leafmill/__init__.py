"""leafmill: document analytics, organisation and search as PySpark plans."""
