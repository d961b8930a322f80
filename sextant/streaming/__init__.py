"""Structured Streaming on stores: a stream of records as upserts, and operations of a store as a stream."""
