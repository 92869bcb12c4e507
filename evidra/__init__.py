"""Evidence-first analytics on Spark."""
