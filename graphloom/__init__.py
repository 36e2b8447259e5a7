"""Evidence-graph analytics as DataFrame transformations on Spark."""
