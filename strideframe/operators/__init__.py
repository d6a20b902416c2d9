"""DataFrame operators; every one names its key and order columns."""
