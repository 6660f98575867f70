"""Readers: tables, gazetteer files, pending work, events and logs."""
