"""The event log as a stream."""
