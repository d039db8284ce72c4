"""sitesignal: Spark-first analytics for structure-filing data and text corpora."""
