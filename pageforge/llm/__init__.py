"""Operators for preparing training data; nothing else in pageforge imports this subpackage."""
