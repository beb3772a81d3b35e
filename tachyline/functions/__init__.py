"""Column helpers and the Arrow wire codec."""
