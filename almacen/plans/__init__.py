"""Plans: the warehouse build and the analytic queries over the star."""
