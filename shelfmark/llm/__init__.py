"""Large-corpus text operators; nothing else in the library imports this subpackage."""
