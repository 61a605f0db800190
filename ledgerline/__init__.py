"""Commerce data quality, modelling and analytics as Spark DataFrame operators."""
