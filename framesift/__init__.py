"""framesift: ranked retrieval and data processing over video keyframes, declared as Spark plans."""
