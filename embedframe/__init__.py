"""embedframe: Matryoshka embeddings and hashed fingerprints as Spark tables."""

__version__ = "0.1.0"
