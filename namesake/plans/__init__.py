"""Whole workflows: topic and class models, pair classifiers, batch and training runs, registered queries."""
