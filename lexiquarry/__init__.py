"""A corpus analytics engine on PySpark: cleaning, text features, lexical statistics, topics and embeddings."""
