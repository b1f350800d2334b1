"""Operators for training corpora of language models; nothing else in the library needs them."""
