"""Readers and writers for requests, labelled cases, reports and event tables."""
