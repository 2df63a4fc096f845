"""Model interfaces with local, deterministic defaults."""
