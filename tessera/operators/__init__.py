"""Model fitting, scoring and diagnostics."""
