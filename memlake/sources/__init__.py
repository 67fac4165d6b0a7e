"""Tables: schemas, the memory store and readers."""
