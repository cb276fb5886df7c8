"""Training-data operators; nothing else in mosaiq imports this subpackage."""
