"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it; the folder imports nothing of the rest of the package.
"""
