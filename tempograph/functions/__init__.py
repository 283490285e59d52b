"""tempograph functions."""
