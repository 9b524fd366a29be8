"""DataFrame -> DataFrame operators; none of them collects a growing table."""
