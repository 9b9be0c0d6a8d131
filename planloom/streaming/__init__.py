"""The camera path as a stream."""
