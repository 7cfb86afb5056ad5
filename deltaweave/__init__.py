"""Continuous subgraph matching on Spark: what each update of an edge stream creates and destroys of a query's embeddings."""
