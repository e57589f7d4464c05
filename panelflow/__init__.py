"""Spark jobs for the data side of a comic-page localization workflow."""
