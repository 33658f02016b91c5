"""Plan shapes shared by operators: profiles, exact quantiles, ordered rows."""
