"""Operators for language-model training corpora, one module each; nothing else in the library imports this subpackage."""
