"""State machines of the operators that need an ordered fold, and metrics."""
