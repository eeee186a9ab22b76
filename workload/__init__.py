"""The registered queries, their planted inputs and their SQL twins."""
