"""Spark jobs that tell when an automatic judge of generated text can be trusted."""
