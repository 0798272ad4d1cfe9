"""Operators a training-data pipeline needs: one module per operator, and their queries."""
