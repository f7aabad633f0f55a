"""End-to-end dataset plans (DS-*): each returns a lazy DataFrame."""
