"""Text, vector and temporal-graph analytics expressed as Spark plans."""
