"""Training-data operators. Nothing outside this subpackage imports it but the query registry's guarded import."""
