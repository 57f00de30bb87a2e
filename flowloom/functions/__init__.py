"""Scalar expressions: identities, paths, secrets, timestamps, labels."""
