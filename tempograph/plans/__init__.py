"""tempograph plans."""
