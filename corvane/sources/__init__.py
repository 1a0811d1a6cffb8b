"""Readers and writers. What needs the network takes a fetch function, so that tests and mocks need none."""
