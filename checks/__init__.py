"""The registered queries: what each runs, and the SQL it must agree with."""
