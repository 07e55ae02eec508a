"""Part of fieldstream."""
