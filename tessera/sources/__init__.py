"""Readers, writers and checks of entity, truth and match files."""
