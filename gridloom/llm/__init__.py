"""Training-data operators: thirteen DataFrame-to-DataFrame components and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when present.
"""
