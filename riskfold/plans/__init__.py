"""Composed jobs: base build, feature fit/apply, preparation, evaluation."""
