"""Training-data operators for language models. Nothing outside this package imports it."""
