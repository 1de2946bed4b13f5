"""Page-delivery analytics on Spark: captured responses in, signals, findings and comparisons out."""
