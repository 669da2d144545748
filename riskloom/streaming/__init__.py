"""The change log fed by a stream of row changes."""
