"""Test doubles. Nothing here is a language model."""
