"""Weight calibration, dataset reduction and their reports on Spark."""
