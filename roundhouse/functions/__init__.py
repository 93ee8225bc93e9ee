"""Pure column functions: they never move rows."""
