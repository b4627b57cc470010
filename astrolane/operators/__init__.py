"""Selections, weights, combination, cross-matching, identities and links."""
