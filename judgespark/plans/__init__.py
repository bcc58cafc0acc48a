"""Named plans over the sample tables: derived inputs, queries and their SQL counterparts."""
