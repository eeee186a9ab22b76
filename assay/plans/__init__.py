"""Tables of experiment plans: extraction, validation and cost."""
