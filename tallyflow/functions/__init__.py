"""Part of tallyflow."""
