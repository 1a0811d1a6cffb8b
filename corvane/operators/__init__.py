"""DataFrame operators; each returns a lazy DataFrame and collects nothing."""
