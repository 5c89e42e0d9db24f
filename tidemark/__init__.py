"""Point-in-time equity analytics as lazy Spark DataFrame plans."""
