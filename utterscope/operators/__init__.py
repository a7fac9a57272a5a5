"""DataFrame-to-DataFrame operators; none of them creates a session or writes output."""
