"""Distributed training: boosted trees, weighted linear learners, repeated games and adaptive group weights."""
