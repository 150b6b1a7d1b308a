"""Query catalogue and helpers shared by the operators."""
