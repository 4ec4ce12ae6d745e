"""sources of factloom."""
