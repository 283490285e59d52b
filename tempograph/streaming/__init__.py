"""tempograph streaming."""
