"""What is asked of a warehouse: audit, model, reconciliation, analysis."""
