"""Training-data operators: tokenising, filtering, packing, extraction,
near and exact de-duplication, quality and language models.  Nothing else in
the library imports this subpackage."""
