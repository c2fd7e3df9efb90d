"""twinsift: duplicate-file analytics as composable PySpark DataFrame operators."""
