"""The online router: the batch operators on unbounded tables of prompts."""
