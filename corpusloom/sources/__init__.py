"""Tables, files, fetched web pages and the append-only stores."""
