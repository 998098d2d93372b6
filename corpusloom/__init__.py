"""corpusloom: text-corpus and experiment analytics expressed as Spark plans."""
