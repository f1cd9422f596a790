"""pageloom: corpus preparation, batch retrieval and evaluation as Spark plans."""
