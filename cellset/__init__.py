"""cellset: Spark DataFrame operators for ragged count cells, vectors and matched sets of cells."""
