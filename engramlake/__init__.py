"""engramlake: set-oriented memory and retrieval analytics on Spark."""
