"""How a stream is ordered, keyed and bucketed."""
