"""Query catalogue, one module per operator family."""
