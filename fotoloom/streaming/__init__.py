"""Streams of logs, jobs, catalogs and tags."""
