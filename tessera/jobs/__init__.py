"""Tessera jobs."""
