"""Filing plans as tables: parsing, numbering, rendering, comparing."""
