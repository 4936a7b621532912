"""Questionnaire scoring, attribution and submission routing as Spark DataFrame transforms."""
