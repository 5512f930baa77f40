"""Registered queries: each is a plan over the driver's tables, with its SQL twin where SQL can express it."""
