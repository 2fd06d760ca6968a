"""Readers and writers: signature catalogues, URL lists, page archives, network logs, result sinks."""
