"""Evidence graphs and hybrid retrieval as Spark jobs over tables."""
