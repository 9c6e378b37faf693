"""Point-in-time analytics on Spark: DataFrame operators for forecasting and decision support."""
