"""streaming of the view engine."""
