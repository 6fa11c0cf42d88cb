"""Whole jobs: the cleaning plan and a run from files to files."""
