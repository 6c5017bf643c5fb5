"""plans of the view engine."""
