"""The change log as a stream, and expiry."""
