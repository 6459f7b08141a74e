"""Join strategies and row placement."""
