"""Jobs that are run from a command line, each with a small JSON config."""
