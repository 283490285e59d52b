"""tempograph sources."""
