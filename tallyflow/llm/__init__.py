"""Training-data operators. Nothing else in tallyflow imports this subpackage."""
