"""Evidence, feasibility and ranking analytics as Spark DataFrame operators."""
