"""marsad: retrieval, evidence checking and corpus preparation as Spark plans."""
