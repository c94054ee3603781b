"""Operators for preparing language-model training data; nothing else in verisift imports this subpackage."""
