"""Compiled operations."""
