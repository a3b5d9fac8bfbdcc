"""Request objects: what a search or an aggregation asks for, checked before any job runs."""
