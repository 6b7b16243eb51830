"""Readers: agent JSON envelopes, flow streams, cloud flow logs, saved sessions."""
