"""Composite plans: silver, gold, the reports over gold, and the jobs that write them."""
