"""The relational, order-based and array operators."""
