"""Proofsieve: checks claims in short messages against registers, as Spark jobs over columns of messages."""
