"""Registered queries: operators applied to the tables, with equivalent SQL."""
