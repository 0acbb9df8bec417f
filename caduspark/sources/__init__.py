"""Readers, writers, policy and event derivation."""
