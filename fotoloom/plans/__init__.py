"""Import, rename and export plans, and whole workloads."""
