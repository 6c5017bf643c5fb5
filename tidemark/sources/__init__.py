"""sources of the view engine."""
