"""Wired-up queries over the supplied tables, with their SQL counterparts."""
