"""DataFrame operators: best-observation selection, dictionary lookups, per-patient
reductions, cohort investigation, audited corrections and data-quality checks."""
