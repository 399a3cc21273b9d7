"""Operators for large training corpora, one module each; see the README for what each returns."""
