"""Column functions: text, time and scores. None of them runs an action."""
