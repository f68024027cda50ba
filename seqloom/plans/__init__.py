"""Parameters, the mapping plan, resumable stages, and the queries."""
