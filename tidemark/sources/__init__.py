"""Where events, messages and memories come from."""
