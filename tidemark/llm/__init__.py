"""Operators for text meant for language models. Nothing outside this folder imports it."""
