"""An episode clip engine and training-data operators for Spark."""
