"""Subpackage of kinfold."""
