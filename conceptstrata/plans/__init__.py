"""End-to-end analyses and the registered queries."""
