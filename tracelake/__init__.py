"""Evidence and timeline analytics on Spark: byte scanning, interval algebra, timelines, recovery and reports as DataFrame operators."""
