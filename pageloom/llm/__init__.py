"""Operators for building training corpora, and the registered queries over them."""
