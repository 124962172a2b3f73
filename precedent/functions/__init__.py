"""precedent: similar-case retrieval and recommendation on Spark."""
