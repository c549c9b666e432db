"""Session settings, shared intermediate tables and staged runs."""
