"""Scans and sinks: MIDI files, manifests, tables of results."""
