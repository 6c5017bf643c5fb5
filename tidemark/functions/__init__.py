"""functions of the view engine."""
