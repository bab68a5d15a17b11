"""DataFrame -> DataFrame operators; lazy, without collect."""
