"""The metric tables as streams."""
