"""Runs: specifications turned into one lazy plan each, and recorded in the run store."""
