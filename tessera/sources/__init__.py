"""Loaders and stores."""
