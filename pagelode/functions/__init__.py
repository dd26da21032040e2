"""Part of the pagelode engine."""
