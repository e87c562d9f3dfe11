"""Prompt complexity, routing and energy accounting as Spark DataFrame jobs."""
