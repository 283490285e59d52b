"""tempograph operators."""
