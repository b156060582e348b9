"""Declaration scanners for source languages, in pure Python."""
