"""Column functions: rules, text measures and embeddings as expressions."""
