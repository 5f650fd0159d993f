"""strandloom: sequencing-style analytics as composable Spark DataFrame operators."""
