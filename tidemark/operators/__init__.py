"""operators of the view engine."""
