"""Due-diligence analytics as composable PySpark operators."""
