"""The folds under Structured Streaming state."""
