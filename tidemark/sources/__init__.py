"""Readers, and adapters that give the synthetic tables the shape of account snapshots."""
