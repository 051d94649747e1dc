"""Wire-telemetry analytics on Spark: requests, responses, joins and rolling statistics as DataFrame plans."""
