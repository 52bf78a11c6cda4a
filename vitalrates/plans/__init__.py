"""End-to-end plans: study configuration, the rates study and the adapter
that derives deaths and population from the benchmark tables."""
