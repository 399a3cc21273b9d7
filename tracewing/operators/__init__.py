"""DataFrame operators: grouping, ordering, joining and document work."""
