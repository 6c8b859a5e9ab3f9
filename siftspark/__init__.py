"""Document screening and evidence ranking on Spark."""
