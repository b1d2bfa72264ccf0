"""Rules, their compilation to plans, hunting and reports."""
