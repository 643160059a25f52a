"""Catalogues that arrive in pieces."""
