"""DataFrame operators of the resolution workflow."""
